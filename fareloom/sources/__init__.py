"""Readers, writers and the small dimensions."""
