"""Training-data operators: language id, similarity search, deduplication, scans and formatting."""
