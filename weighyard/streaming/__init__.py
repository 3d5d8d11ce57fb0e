"""Live tallies on Structured Streaming."""
