"""functions of strandloom."""
