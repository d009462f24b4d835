"""Input adapters and the registered queries."""
