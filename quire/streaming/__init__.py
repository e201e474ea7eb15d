"""Structured Streaming forms of the limits and the pipeline."""
