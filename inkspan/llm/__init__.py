"""Operators for preparing language-model training data.

Each module holds one operator with a general interface and, at its end, the thin
query that applies it to a whole table.  Nothing outside this package imports it.
"""
