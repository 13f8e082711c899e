"""Operators for training data: each solves one problem of the text corpus; nothing outside imports this package."""
