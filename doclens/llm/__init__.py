"""Operators for preparing training corpora. Nothing else in doclens imports this package."""
