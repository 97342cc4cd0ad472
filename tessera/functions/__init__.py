"""Column functions: text, dates, scores, patterns."""
