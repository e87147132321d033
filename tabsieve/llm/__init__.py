"""Training-data operators: language id, near-duplicate detection, vector
search, quality scoring, tokenization, mixing, sharding and line dedup."""
