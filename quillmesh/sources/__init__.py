"""Scans: parquet tables, JSONL artifacts, layout JSON, manifests."""
