"""Streaming faces of batch operators."""
