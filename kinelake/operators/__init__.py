"""Distributed operators of the core package."""
