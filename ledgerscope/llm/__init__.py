"""Training-data operators: deduplication, decontamination, scans, scoring, packing and sharding of documents."""
