"""Tidemark: a self-scoring forecast warehouse expressed as Spark DataFrames.

Data whose values are revised after publication is landed append-only, resolved
to its latest or then-known value, aligned to a half-hour spine, forecast,
sealed, scored and audited. Each operator is a function from DataFrames to a
DataFrame; ``as_of`` stands in for the wall clock everywhere.
"""

__version__ = "0.1.0"
