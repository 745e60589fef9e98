"""Training-data operators: token output, PII, near duplicates, packing, search,
sharding, toxicity, WARC, quality and benchmark decontamination."""
