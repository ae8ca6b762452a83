"""Training-data operators: sharding, quality, extraction, tokens, privacy and duplicates."""
