"""Readers and writers for pages, triples, embeddings and logs."""
