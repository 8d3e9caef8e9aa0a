"""Column-level building blocks: text, markup, terms, scores, SQL functions."""
