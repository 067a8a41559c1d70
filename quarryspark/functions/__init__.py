"""Column functions: pure Catalyst expressions."""
