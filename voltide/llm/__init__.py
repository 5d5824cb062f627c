"""Training-data operators: text deduplication, mixing, tokenisation, quality, language, sharding and search."""
