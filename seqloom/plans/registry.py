"""All queries of the library with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import VIEWS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_VIEWS = {m[1]: m[0].rstrip().rstrip(",") for m in re.finditer(r"^(v_\w+) AS .*?(?=^v_\w+ AS |\Z)", VIEWS_SQL, re.M | re.S)}


def _needs(sql: str) -> list[str]:
    """The views that some SQL names, those that they build on first."""
    out: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        if name in _VIEWS:
            own = _VIEWS[name].split(" AS ", 1)[1]
            out += [n for n in [*_needs(own), name] if n not in out]
    return list(dict.fromkeys(out))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` may use the views by name. It may start with own common table
    expressions (``name AS (...), ... SELECT``), recursive ones too."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            body = sql.strip()
            views = [_VIEWS[n] for n in _needs(body)]
            own = not body.upper().startswith(("SELECT", "FROM"))
            sql_text = ("WITH RECURSIVE " + ",\n".join(views) + (",\n" if views and own else "\n") + body) if views or own else body
            ORACLE[name] = re.sub(r'(?<!")\bat\b(?!")', '"at"', sql_text)  # a reserved word to some parsers
        return fn

    return add


from . import frames, grids, ledgers, signals, streams, texts, timelines  # noqa: E402, F401
