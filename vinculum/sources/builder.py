"""A fluent query builder that compiles to a DataFrame plan.

Filters AND together and follow SQL's three-valued logic: null never matches. Limits apply after all filters.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_contains(column: Column, wanted: dict, path: str = "$") -> Column:
    """Whether a JSON text holds every key of `wanted` with an equal value, at any depth."""
    tests = []
    for k, v in wanted.items():
        at = f"{path}['{k}']"
        if isinstance(v, dict):
            tests.append(json_contains(column, v, at))
        else:
            text = v if isinstance(v, str) else json.dumps(v)
            tests.append(F.coalesce(F.get_json_object(column, at) == text, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class Query:
    """Collects filters, order and range; `df()` compiles them. Every call returns the builder."""

    def __init__(self, source: DataFrame):
        self._source, self._columns = source, ["*"]
        self._where: list[Column] = []
        self._order: list[Column] = []
        self._limit: int | None = None
        self._offset = 0

    def select(self, columns: str = "*") -> "Query":
        self._columns = [c.strip() for c in columns.split(",")]
        return self

    def where(self, condition: Column) -> "Query":
        self._where.append(condition)
        return self

    def eq(self, column: str, value: Any) -> "Query":
        return self.where(F.col(column) == value)

    def neq(self, column: str, value: Any) -> "Query":
        return self.where(F.col(column) != value)

    def gt(self, column: str, value: Any) -> "Query":
        return self.where(F.col(column) > value)

    def gte(self, column: str, value: Any) -> "Query":
        return self.where(F.col(column) >= value)

    def lt(self, column: str, value: Any) -> "Query":
        return self.where(F.col(column) < value)

    def lte(self, column: str, value: Any) -> "Query":
        return self.where(F.col(column) <= value)

    def like(self, column: str, pattern: str) -> "Query":
        return self.where(F.col(column).like(pattern))

    def ilike(self, column: str, pattern: str) -> "Query":
        return self.where(F.col(column).ilike(pattern))

    def or_ilike(self, patterns: dict[str, str]) -> "Query":
        return self.where(reduce(lambda a, b: a | b, (F.col(c).ilike(p) for c, p in patterns.items())))

    def is_(self, column: str, value: str | None) -> "Query":
        if value not in (None, "null", "not.null"):
            raise ValueError(f"is_: {value!r} is neither null nor not.null")
        return self.where(F.col(column).isNotNull() if value == "not.null" else F.col(column).isNull())

    def in_(self, column: str, values: list) -> "Query":
        return self.where(F.col(column).isin(list(values)))

    def contains(self, column: str, value: list | dict) -> "Query":
        """An array holds all of a list; a JSON text holds a dict."""
        if isinstance(value, dict):
            return self.where(json_contains(F.col(column), value))
        return self.where(F.size(F.array_except(F.array(*map(F.lit, value)), F.col(column))) == 0)

    def contained_by(self, column: str, values: list) -> "Query":
        return self.where(F.col(column).isNotNull() & (F.size(F.array_except(F.col(column), F.array(*map(F.lit, values)))) == 0))

    def range_(self, column: str, low: Any, high: Any) -> "Query":
        return self.where(F.col(column).between(low, high))

    def text_search(self, column: str, query: str) -> "Query":
        """Every word of the query is a word of the text, in any case."""
        tokens = F.split(F.lower(F.col(column)), "[^a-z0-9]+")
        return self.where(reduce(lambda a, b: a & b, (F.array_contains(tokens, w) for w in query.lower().split())))

    def tenant(self, client_id: str, public: bool = False, column: str = "client_id") -> "Query":
        own = F.col(column) == client_id
        return self.where(own | F.col(column).isNull() if public else own)

    def order(self, column: str, desc: bool = False, nullsfirst: bool = False) -> "Query":
        c = F.col(column)
        self._order.append((c.desc_nulls_first() if nullsfirst else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if nullsfirst else c.asc_nulls_last()))
        return self

    def limit(self, n: int) -> "Query":
        self._limit = n
        return self

    def offset(self, n: int) -> "Query":
        self._offset = n
        return self

    def range(self, start: int, end: int) -> "Query":
        """Rows start to end, both counted in."""
        self._offset, self._limit = start, end - start + 1
        return self

    def filtered(self) -> DataFrame:
        return reduce(lambda d, c: d.where(c), self._where, self._source)

    def count(self) -> DataFrame:
        """The exact number of rows before any limit, as one row (count)."""
        return self.filtered().agg(F.count("*").alias("count"))

    def df(self) -> DataFrame:
        out = self.filtered()
        if self._order:
            out = out.orderBy(*self._order)
        if self._offset:
            out = out.offset(self._offset)
        if self._limit is not None:
            out = out.limit(self._limit)
        return out.select(*self._columns)

    def single(self) -> dict:
        rows = self.df().limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"single: {'no' if not rows else 'more than one'} row")
        return rows[0].asDict(recursive=True)

    def maybe_single(self) -> dict | None:
        rows = self.df().limit(2).collect()
        if len(rows) > 1:
            raise ValueError("maybe_single: more than one row")
        return rows[0].asDict(recursive=True) if rows else None

    def update(self, **values: Any) -> DataFrame:
        """The whole source with the matching rows changed."""
        hit = reduce(lambda a, b: a & b, self._where, F.lit(True))
        return self._source.select(*(F.when(hit, F.lit(values[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in self._source.dtypes))

    def delete(self) -> DataFrame:
        """The source without the matching rows."""
        return self._source.where(~F.coalesce(reduce(lambda a, b: a & b, self._where, F.lit(True)), F.lit(False)))
