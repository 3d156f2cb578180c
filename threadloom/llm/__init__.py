"""Training-data operators: cleaning, deduplication, tokenising, packing, formatting and scoring of text corpora."""
