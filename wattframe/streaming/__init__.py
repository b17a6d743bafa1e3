"""Live paths under Structured Streaming."""
