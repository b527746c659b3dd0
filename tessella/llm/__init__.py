"""Operators for preparing large text and media corpora."""
