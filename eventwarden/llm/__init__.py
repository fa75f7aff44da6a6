"""Operators for training data: one module per operator, queries in ``queries``."""
