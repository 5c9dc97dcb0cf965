"""Column expressions: calendar, clock, address and fines."""
