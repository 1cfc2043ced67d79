"""Versioned key-value analytics on Spark: mutation logs, command folds, replication checks."""
