"""Operators for training text: detection, near copies, search, classifiers, tokens."""
