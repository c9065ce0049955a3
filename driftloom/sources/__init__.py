"""Readers for captured data and writers for the engine's tables."""
