"""Column expressions: dates, provider values, selectors, identifiers."""
