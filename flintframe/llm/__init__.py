"""Training-data operators: quality, language, mixing, filtering, chat, decontamination, secrets, sharding, joins, toxicity."""
