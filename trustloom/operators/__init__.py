"""Relational, graph and state operators."""
