"""streaming of strandloom."""
