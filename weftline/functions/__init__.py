"""Column functions: occurrences of patterns, brackets, paths, predicates, similarity."""
