"""Training-data operators: language ID, quality rules, toxicity, PII,
fingerprints, near- and substring-deduplication, mixing, packing and token
output.  Nothing else in the library imports this subpackage."""
