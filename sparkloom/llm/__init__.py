"""Operators for preparing large-scale training data.

Nothing outside this subpackage imports it; ``queries`` holds the thin query
wrappers that the entry module registers when this folder is present.
"""
