"""Column expressions: bits of packed verdicts, text normalization, alias rules, classification."""
