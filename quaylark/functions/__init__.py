"""Column expressions: hashing, schedules, signals, tokens, paths."""
