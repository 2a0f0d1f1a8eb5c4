"""Column expressions: numbers, angles, text keys and geodesy."""
