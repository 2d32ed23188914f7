"""Column functions: wiki markup, text analysis, and the stemmer."""
