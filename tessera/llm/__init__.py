"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface and the thin query that ``__spark_entry__`` registers; the
modules are listed in :mod:`tessera.llm.registry`.
"""
