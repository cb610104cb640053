"""Table operators: validate, report, duplicates, violations, split, profile."""
