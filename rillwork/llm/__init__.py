"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it, so it can be deleted without
touching the rest of the library.
"""
