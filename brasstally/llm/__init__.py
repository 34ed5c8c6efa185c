"""Training-data operators: toxicity, quality, dedup, fingerprints, mixing, packing and extraction."""
