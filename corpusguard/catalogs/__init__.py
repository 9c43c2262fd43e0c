"""Fixed values that the operators go by, as plain tables."""
