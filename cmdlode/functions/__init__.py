"""Column expressions: text, redaction, similarity, formatting, paths."""
