"""Column expressions: text, filters, scoring rules, quantiles."""
