"""Column builders; no Python UDFs."""
