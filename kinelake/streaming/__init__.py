"""Structured Streaming forms of the episode operators."""
