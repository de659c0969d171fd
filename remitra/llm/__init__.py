"""Operators that prepare text for training, and the queries that apply them."""
