"""Structured Streaming operators: notifications, incremental ingest, back-fill phases."""
