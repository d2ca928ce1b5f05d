"""Training-data operators: packing, near-duplicates, quality, toxicity, search, PII, BPE, WARC."""
