"""Column expressions: encoders and parsers."""
