"""Structured Streaming: live feed, per-batch cleaning, live annotation."""
