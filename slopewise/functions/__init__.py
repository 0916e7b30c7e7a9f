"""Column expressions: geometry, text, packing."""
