"""Operators for language-model training data: nearest-time pairing, encoding, mixing, look-alike texts.

Nothing else in the library imports this subpackage.
"""
