"""lodestar: a PySpark-native analytics engine for research-portfolio data."""
