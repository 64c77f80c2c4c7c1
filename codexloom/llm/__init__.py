"""Operators for preparing language-model training text.

Each module holds one operator with a general interface; ``queries`` holds the
thin contract queries.  Nothing outside this subpackage imports it.
"""
