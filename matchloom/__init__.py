"""Spark-native match analytics: point-in-time features, insight aggregates and audits."""
