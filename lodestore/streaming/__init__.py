"""Streaming faces of the operators."""
