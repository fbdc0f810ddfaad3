"""llm of strandloom."""
