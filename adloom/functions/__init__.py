"""Column expressions: URLs, text, patterns, and the HTML selection function."""
