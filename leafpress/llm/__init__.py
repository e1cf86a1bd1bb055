"""Training-data operators: dedup, quality, sampling, search and packing over document tables."""
