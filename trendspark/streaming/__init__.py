"""Structured Streaming wrappers: the batch jobs run per micro-batch (foreachBatch)."""
