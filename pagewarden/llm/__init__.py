"""Training-data operators: search, deduplication, quality, mixing, filtering, packing, sharding."""
