"""Training-data operators: fingerprints, language-model scores, packing, BPE,
near-duplicate detection, page extraction, licence scans, toxicity, line dedup."""
