"""Spark-native causal discovery and probabilistic modelling over tables."""
