"""Column functions: text, dates, maps and plane geometry."""
