"""Readers and writers of mesh files."""
