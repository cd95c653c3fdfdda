"""Training-data operators: sharding, dedup, decontamination, tokenization, quality."""
