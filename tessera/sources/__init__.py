"""Readers of text inputs, writers of text outputs, and a generator of skewed relations."""
