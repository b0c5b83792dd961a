"""Column functions: byte globs, integer parsing, filter hashing."""
