"""Structured Streaming forms of the bar operators (an extension of the batch engine)."""
