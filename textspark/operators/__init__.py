"""Operators over tables of texts, tokens, spans and conversations."""
