"""Operators for building training corpora: duplicates, language, tokens, mixtures and archives."""
