"""Spark-native reconciliation of billing evidence and complaint analytics."""
