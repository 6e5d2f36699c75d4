"""Readers of documents and sheets, writers of results, and views over the benchmark tables."""
