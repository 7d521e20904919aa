"""Column functions: text rules, normalisers, extraction, metrics."""
