"""Column functions: keys, hashes, number parsing, rules."""
