"""Column functions: text, URLs, dates, rules."""
