"""Column expressions: text rules, number grammars, identifier checksums, validators."""
