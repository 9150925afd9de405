"""Column expressions: scores, tags, predicates."""
