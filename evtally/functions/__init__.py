"""Column builders: identities, measures, times."""
