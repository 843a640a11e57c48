"""Readers and writers of lexicon releases, candidate files and evaluation sets."""
