"""The same quote flow as Structured Streaming."""
