"""operators of strandloom."""
