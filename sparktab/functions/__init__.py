"""Column expressions: token costs, cell encodings, text helpers."""
