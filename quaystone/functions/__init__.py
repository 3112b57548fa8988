"""Column functions: text, dates, geography, HTML."""
