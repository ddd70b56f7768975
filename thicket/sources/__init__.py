"""Readers: files of documents, manual relations, stored graphs, configuration."""
