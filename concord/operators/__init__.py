"""DataFrame operators: rule joins, packed verdicts, agreement, corpus, reproducers, samples, hashes, runs, checks."""
