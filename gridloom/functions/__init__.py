"""Column expressions on cell values."""
