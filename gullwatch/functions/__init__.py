"""Column -> Column functions. No Python UDFs."""
