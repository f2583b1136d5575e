"""Training-data operators: cleaning, counting, dedup, mixing, packing, scanning, archives."""
