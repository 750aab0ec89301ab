"""Training-data pipeline operators: quality, secrets, tokens, language, dedup, media, mixing, packing, WARC."""
