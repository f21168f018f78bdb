"""Operators for preparing language-model training data. Nothing else in tidemark imports this package."""
