"""Training-data operators: archives, quality, licences, packing, deduplication, tokens, decontamination."""
