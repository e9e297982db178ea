"""Training-data operators: deduplication, tokenising, filtering, sharding, formatting and decontamination."""
