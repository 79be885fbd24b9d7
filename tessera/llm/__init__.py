"""Training-data operators: deduplication, filters, tokenising, packing and sharding."""
