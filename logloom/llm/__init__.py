"""Operators for preparing training data: ten components, each over whole tables, on Spark."""
