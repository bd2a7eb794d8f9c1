"""Structured Streaming over the event table (an extra: the dialect itself has no streams)."""
