"""Whole queries and the engine over a store."""
