"""Training-data operators: archives, cleaning, deduplication, mixing, encoding and language identification."""
