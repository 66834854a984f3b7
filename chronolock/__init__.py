"""Event-locked time-series analytics on Spark."""
