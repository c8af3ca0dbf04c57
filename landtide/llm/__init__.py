"""Training-data operators: filters, deduplication, scoring, mixing, tokenizing."""
