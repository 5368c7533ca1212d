"""Structured Streaming jobs: incremental bulk load of new CSV files."""
