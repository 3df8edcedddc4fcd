"""Column expressions: losses, metrics, random draws, special functions."""
