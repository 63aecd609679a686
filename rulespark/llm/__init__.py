"""Operators for building training corpora: one module for each operator.

Nothing outside this folder imports it.  `entries.py` lists the queries.
"""
