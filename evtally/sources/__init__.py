"""Readers of evidence documents, and the table store."""
