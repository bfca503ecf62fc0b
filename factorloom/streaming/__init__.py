"""Factors of bars that arrive as a stream."""
