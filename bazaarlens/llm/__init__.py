"""Operators that prepare text for training. Nothing else in the library imports this package."""
