"""Every operator as a query over the driver's tables, with its SQL where SQL can say it."""

from tidemark.queries import feeds, forecasting, landing, register, spine  # noqa: F401
from tidemark.queries.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
