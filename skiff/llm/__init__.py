"""Training-data operators: extraction, language, quality, duplicates, secrets, packing."""
