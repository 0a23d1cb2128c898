"""Operators for preparing language-model training data, each a job over whole tables.

Nothing outside this subpackage imports it; its queries and SQL are in ``queries.py``.
"""
