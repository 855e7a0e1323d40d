"""Where words, rules, verdicts and records come from, and where they are written to."""
