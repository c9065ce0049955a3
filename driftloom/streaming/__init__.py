"""Incremental forms of the state operators."""
