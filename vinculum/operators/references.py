"""References to records that do not exist.

A reference is a tuple of columns that names a record of another table. References to one parent are grouped by
their null mask, and each mask is anti-joined on its non-null columns under the declared match semantics:

* ``simple``  - a reference with any null column is no reference.
* ``full``    - all columns null is no reference; some null is a violation (reason ``partial``).
* ``partial`` - all null is no reference; otherwise some parent must agree on the non-null columns.

Reasons, first that holds: ``partial``, ``missing`` (no parent has that key), ``deleted`` (every parent with that key is
deleted), ``late`` (every live parent with that key was created after the referring row). A null creation time on
either side is never late.
Nulls and blanks are no reference, repeated rows count once, empty tables give no rows. Only the named columns are
read, so extra columns with clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.operators.skew import salted_join
from vinculum.session import clean_id

OUT = ["ref_field", "row_id", "period", "reason"]


@dataclass
class Parent:
    """A table that is referred to. `deleted`: true for a deleted state. With `updated`, the latest state of a key counts."""

    df: DataFrame
    keys: list[str]
    deleted: Column
    created: str = "created_at"
    updated: str | None = "updated_at"


@dataclass
class Reference:
    """Columns of `df` that refer to a parent; `name` labels them in the result."""

    name: str
    df: DataFrame
    row_id: str
    columns: list[str]
    created: str = "created_at"
    match: str = "simple"
    extra: dict[str, Column] = field(default_factory=dict)


def current_parents(parent: Parent) -> DataFrame:
    """(k0.., dead, born): the current state of each key.

    The state with the greatest `updated` is current; ties go to the latest creation, then to a live state.
    """
    keys = [clean_id(k).alias(f"k{i}") for i, k in enumerate(parent.keys)]
    rows = parent.df.select(*keys, F.coalesce(parent.deleted, F.lit(False)).alias("dead"), F.col(parent.created).alias("born"), (F.col(parent.updated) if parent.updated else F.lit(0)).alias("at"))
    state = F.max(F.struct("at", "born", (~F.col("dead")).alias("live"))).alias("s")
    names = [f"k{i}" for i in range(len(keys))]
    return rows.groupBy(*names).agg(state).select(*names, (~F.col("s.live")).alias("dead"), F.col("s.born").alias("born"))


def _rows(ref: Reference) -> DataFrame:
    keys = [clean_id(c).alias(f"k{i}") for i, c in enumerate(ref.columns)]
    return ref.df.select(F.lit(ref.name).alias("ref_field"), F.col(ref.row_id).alias("row_id"), F.col(ref.created).alias("at"), *keys, F.lit(ref.match).alias("match"))


def find_orphans(parent: Parent, refs: list[Reference]) -> DataFrame:
    """One row (ref_field, row_id, period, reason) for each reference to `parent` that fails.

    All references with as many columns as the parent's key share one shuffle; a key that many rows name is salted.
    """
    width = len(parent.keys)
    if any(len(r.columns) != width or r.match not in ("simple", "full", "partial") for r in refs):
        raise ValueError("a reference needs as many columns as the parent's key, and a match of simple, full or partial")
    rows = reduce(DataFrame.unionByName, map(_rows, refs))
    parents = current_parents(parent)
    period = F.date_format("at", "yyyy-MM")
    found: list[DataFrame] = []
    every = (1 << width) - 1
    present = reduce(lambda a, b: a + b, (F.when(F.col(f"k{i}").isNotNull(), 1 << i).otherwise(0) for i in range(width)))
    kinds = {r.match for r in refs}
    for mask in range(1, every + 1):
        if mask != every and kinds == {"simple"}:
            continue
        own = rows.where(present == mask)
        if mask != every:
            if "full" in kinds:
                found.append(own.where("match = 'full'").select("ref_field", "row_id", period.alias("period"), F.lit("partial").alias("reason")))
            if "partial" not in kinds:
                continue
            own = own.where("match = 'partial'")
        cols = [f"k{i}" for i in range(width) if mask >> i & 1]
        key = F.col(cols[0]) if len(cols) == 1 else F.to_json(F.array(*cols))
        own = own.withColumn("key", key)
        # several parents may agree on part of a key: it is alive if one is, since the first live one was born
        some = parents.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))).withColumn("key", key)
        some = some.groupBy("key").agg(F.lit(True).alias("known"), F.bool_or(~F.col("dead")).alias("live"), F.min(F.when(~F.col("dead"), F.coalesce("born", F.lit("0001-01-01").cast("timestamp")))).alias("born"))
        reason = F.when(F.col("known").isNull(), "missing").when(~F.col("live"), "deleted").when(F.col("born") > F.col("at"), "late")
        found.append(salted_join(own, some, "key", F.col("row_id")).select("ref_field", "row_id", period.alias("period"), reason.alias("reason")).where("reason is not null"))
    return reduce(DataFrame.unionByName, found).select(*OUT).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Failing references per field, period and reason."""
    return orphans.groupBy("ref_field", "period", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("row_id").alias("n_rows"))


def clean_references(parent: Parent, ref: Reference) -> DataFrame:
    """The rows of the referring table whose reference does not fail, as they are; rows without a reference stay."""
    bad = find_orphans(parent, [ref]).select(F.col("row_id").alias(ref.row_id)).distinct()
    return ref.df.join(bad, ref.row_id, "left_anti")
