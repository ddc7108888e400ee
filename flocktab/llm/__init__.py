"""Operators for preparing language-model training data, each one Spark job or a short chain of them."""
