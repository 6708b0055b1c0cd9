"""Column functions: text in, text or struct out. No UDFs."""
