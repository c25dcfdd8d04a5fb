"""Operators for preparing large text and embedding corpora."""
