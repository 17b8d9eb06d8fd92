"""Operators for building training corpora.

Nothing outside this subpackage imports it; ``queries`` registers its
production queries.
"""
