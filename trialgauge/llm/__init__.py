"""Training-data operators: deduplication, quality, language, decontamination, packing, secrets, sharding."""
