"""Training-data operators: deduplication, filtering, formatting, sharding and tokenising."""
