"""Readers: snapshots, change files, adapters."""
