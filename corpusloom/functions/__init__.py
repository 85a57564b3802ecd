"""Column expressions: text in a cell, arrays in a cell, seeded draws."""
