"""Structured Streaming jobs: live scoring, incremental ingest, lock-outs."""
