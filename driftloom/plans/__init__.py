"""Named queries and whole-run plans."""
