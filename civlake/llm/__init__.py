"""Operators on texts and vectors for training data; nothing outside this subpackage imports it."""
