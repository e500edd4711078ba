"""Column functions: text analysis and display strings."""
