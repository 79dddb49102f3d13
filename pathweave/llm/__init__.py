"""Training-data operators: quality, toxicity, near duplicates, mixing, packing, archives, chat logs."""
