"""Micro-batch form of the check."""
