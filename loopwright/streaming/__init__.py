"""The feedback, serving and export flows as Structured Streaming queries."""
