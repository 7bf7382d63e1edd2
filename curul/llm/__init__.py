"""Training-data operators: deduplication, fingerprints, scans, extraction, packing and archives."""
