"""Log lines in Structured Streaming."""
