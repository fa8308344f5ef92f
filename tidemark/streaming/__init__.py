"""Structured Streaming forms of ingestion and alerting."""
