"""Structured Streaming counterparts of the batch readers and exporters."""
