"""Column functions: text, JSON, arrays, scores."""
