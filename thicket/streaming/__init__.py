"""Structured Streaming: graphs that grow as documents arrive, and co-occurrence over event time."""
