"""Plans: predicates compiled to columns, and lazy queries."""
