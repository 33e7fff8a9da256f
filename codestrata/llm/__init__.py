"""Operators for training data made of source code and the texts about it."""
