"""Column expressions: text, number, date and name rules."""
