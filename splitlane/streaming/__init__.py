"""Structured Streaming forms of ingest, session samples, deciding and retraining."""
