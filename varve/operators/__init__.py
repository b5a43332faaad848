"""Relational operators over the mutation log."""
