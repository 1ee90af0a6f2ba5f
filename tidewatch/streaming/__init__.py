"""The operators under Structured Streaming."""
