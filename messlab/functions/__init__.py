"""Column expressions: seeded draws, word lists, value generators, date formats."""
