"""Relational operators over the document state tables."""
