"""Training-data operators: fingerprints, deduplication, scoring, archives, packing, chat."""
