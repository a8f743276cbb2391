"""Readers and writers of the space-separated text relations and of Parquet tables."""
