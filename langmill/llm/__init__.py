"""Operators for building training corpora of language models."""
