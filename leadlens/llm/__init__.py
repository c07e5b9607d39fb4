"""Training-data operators: search, tokenization, dedup, archives, filters and scoring."""
