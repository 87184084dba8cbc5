"""The incremental parts of the pipeline as Structured Streaming queries."""
