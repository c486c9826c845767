"""Training-data operators: dedup, extraction, packing, search and classification on Spark."""
