"""Operators for building training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the registered ``opN_*`` queries in :mod:`lodestrand.llm.queries`
derive digest columns from the operators' real outputs.
"""
