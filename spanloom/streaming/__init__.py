"""The row-wise chains on Structured Streaming."""
