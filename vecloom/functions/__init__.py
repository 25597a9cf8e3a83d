"""Vector functions, metrics and aggregates as Catalyst expressions."""
