"""Column expressions: paths, identifiers, documentation text, severities."""
