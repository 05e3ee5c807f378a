"""Training-data operators: near-duplicates, mixing, packing, sharding, scans, filters and scorers."""
