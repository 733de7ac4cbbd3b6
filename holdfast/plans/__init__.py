"""The registry of queries, each with DuckDB SQL where SQL can express it."""

from . import more, queries  # noqa: F401 - registers its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
