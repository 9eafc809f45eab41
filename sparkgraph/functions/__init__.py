"""Column expressions for terms: casts, comparison, ordering and display."""
