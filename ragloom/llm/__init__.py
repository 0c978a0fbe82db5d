"""Training-data operators: deduplication, mixing, filtering, formatting, packing."""
