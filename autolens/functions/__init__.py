"""Column functions, name rules and fixed values."""
