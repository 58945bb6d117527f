"""Query catalogue: each entry has a DataFrame builder and an ANSI SQL twin."""
