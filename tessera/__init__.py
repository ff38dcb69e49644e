"""Spark-native analytics for counterfactual panel data."""
