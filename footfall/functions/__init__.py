"""Column expressions: text, digests, vectors."""
