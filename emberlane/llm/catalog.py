"""Queries of this subpackage by name, and the DuckDB SQL they are compared with."""

from __future__ import annotations

from . import queries
from .oracles import ORACLES

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}

__all__ = ["ORACLES", "QUERIES"]
