"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it. Each operator lives in a module of its own;
``queries`` registers the thin ``opN_*`` queries over the test tables.
"""
