"""Readers and writers: JSON lines, dictionaries, models, crowd files."""
