"""Readers and writers: Parquet, JSON lines, whole JSON documents, raw lines, CSV/TSV."""
