"""Graph updates: append, replace, smart merge; in batch, or for every micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.functions.columns import canonical_form


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def replace(old: DataFrame, new: DataFrame, document: str = "document_id") -> DataFrame:
    """Everything of the new rows' documents goes first. Rows of no document stay."""
    return append(old.join(new.select(document).where(F.col(document).isNotNull()).distinct(), document, "left_anti").select(*old.columns), new)


def smart(old: DataFrame, new: DataFrame, name: str, kind: str) -> DataFrame:
    """New rows that name a known record (canonical form and type) are left out; of equal new ones the first id stays."""
    k = [canonical_form(F.col(name)).alias("_n"), F.upper(F.trim(F.col(kind))).alias("_k")]
    known = old.select(*k).distinct()
    fresh = new.select("*", *k).join(known, ["_n", "_k"], "left_anti").dropDuplicates(["_n", "_k"]).drop("_n", "_k")
    return append(old, fresh.select(*new.columns))


def each_batch(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], merge: Callable[[DataFrame, DataFrame], DataFrame]):
    """A foreachBatch function that merges every micro-batch into the table and puts the new version in place."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(merge(read(), batch))

    return run
