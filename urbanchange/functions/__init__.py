"""Column expressions and the exact, skew-proof building blocks of the operators."""
