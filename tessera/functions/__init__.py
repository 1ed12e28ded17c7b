"""Column functions: text, scores, colours, hashes."""
