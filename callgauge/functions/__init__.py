"""Column functions: redaction, text helpers, metadata, time, outcome, quantiles."""
