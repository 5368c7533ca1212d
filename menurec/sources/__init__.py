"""Sources: parquet scans, the fixture adapter, CSV bulk load, encoder state."""
