"""Corpus preparation for training data: ten operators, their queries and their SQL."""
