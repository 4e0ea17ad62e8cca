"""Structured Streaming variant of the 5 -> 15 minute frame rollup (optional; the batch
jobs are the reference behaviour)."""
