"""Training-data operators: quality, licences, duplicates, mixing, privacy, toxicity, packing, secrets, search."""
