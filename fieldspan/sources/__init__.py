"""Readers and writers: JSON lines (plain or gzipped), CSV, Parquet and catalog tables."""
