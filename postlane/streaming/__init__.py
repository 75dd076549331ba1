"""The batch jobs as Structured Streaming queries over landed files."""
