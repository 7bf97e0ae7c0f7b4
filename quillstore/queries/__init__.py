"""The registered queries of the engine's operators, each with its DuckDB SQL."""

from . import forms, statements
from .engine import flagship, key_range_slice
from .registered import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship", "forms", "key_range_slice", "statements"]
