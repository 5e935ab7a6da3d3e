"""The registered queries over the given tables, and the SQL each must agree with."""

from millrace.queries.oracles import ORACLES
from millrace.queries.registry import QUERIES

__all__ = ["ORACLES", "QUERIES"]
