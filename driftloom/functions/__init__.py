"""Column-level building blocks: text, predicates, ids, recency, weeks and summary text."""
