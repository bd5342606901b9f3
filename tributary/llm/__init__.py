"""Operators for building training corpora at scale.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame and returns DataFrames; the ``opN_*`` queries in ``queries`` are thin
digests of what the operators return.
"""
