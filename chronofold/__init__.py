"""Event-sourced analytics on Spark: append-only logs, ordered folds, read models."""
