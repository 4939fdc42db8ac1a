"""Relational operators over storage metadata."""
