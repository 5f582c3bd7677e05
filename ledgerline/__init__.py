"""Spark-native end-of-day market data and financial-distress analytics."""
