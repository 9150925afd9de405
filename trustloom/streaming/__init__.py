"""Incremental maintenance."""
