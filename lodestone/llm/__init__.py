"""Training-data operators: scans, filters, deduplication, mixing."""
