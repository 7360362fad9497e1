"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_<name>`` queries, the sibling modules hold the operators themselves.
"""
