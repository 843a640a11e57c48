"""Composed plans: the public check API and the registered queries."""
