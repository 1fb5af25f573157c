"""Operators for training-data pipelines over text, vectors and conversations.

Nothing else in the package imports this one; `registry` holds the queries.
"""
