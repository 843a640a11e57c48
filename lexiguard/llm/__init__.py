"""Operators for preparing training text; nothing else in the package imports this."""
