"""Readers, writers and fixed seed rows."""
