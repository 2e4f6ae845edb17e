"""Streaming twins of batch pipelines."""
