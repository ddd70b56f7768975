"""Whole plans: from documents or tables to graphs, and the catalogue of queries."""
