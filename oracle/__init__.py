"""Independent DuckDB SQL for every query whose result SQL can express."""

from __future__ import annotations

from .analysis import analysis
from .cleaning import cleaning
from .clustering import clustering
from .reports import reports


def all_sql() -> dict[str, str]:
    return {**cleaning(), **analysis(), **clustering(), **reports()}
