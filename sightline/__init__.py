"""sightline: a Spark-native engine for auditing detection data and judging detection models."""
