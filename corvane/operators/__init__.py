"""Relational operators over the file index."""
