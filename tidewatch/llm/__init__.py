"""Operators for training data: each module holds one operator with its general interface."""
