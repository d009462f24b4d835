"""Readers and writers: metadata, images, metrics tables, documents and run manifests."""
