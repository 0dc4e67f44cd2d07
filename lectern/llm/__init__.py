"""Training-data operators: scoring, deduplication, decontamination, token ledgers and source mixing."""
