"""Relational operators over library tables."""
