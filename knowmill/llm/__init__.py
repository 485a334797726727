"""Operators on texts and vectors for training corpora."""
