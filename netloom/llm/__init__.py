"""Operators for large training-data corpora; nothing else in netloom imports them."""
