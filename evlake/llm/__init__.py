"""Training-data operators: deduplication, tokenising, quality, privacy and packing jobs on Spark."""
