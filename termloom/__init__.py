"""termloom: text retrieval and text-collection analytics on Spark DataFrames.

Every public operator takes and returns DataFrames, so that Catalyst plans the
whole query. Subpackages: ``functions`` (column and scalar functions),
``operators`` (index builders and queries), ``plans`` (query parsing, the query
catalogue and its SQL), ``sources`` (readers and writers) and ``streaming``
(incremental index upkeep).
"""
