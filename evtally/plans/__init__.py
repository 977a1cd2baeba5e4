"""Composite plans: derivation and the ledger's life cycle."""
