"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.session import shuffle_width


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys that may hold more than `share` of the rows, at most 1/share of them.

    One pass without a shuffle (frequent-items sketch, merged per task), so the list that reaches the driver has
    a proven bound; it may name a key that is not hot, which costs a few copies only.
    """
    row = df.select(F.col(key).alias("k")).where("k is not null").freqItems(["k"], share).first()
    return [k for k in (row[0] or []) if k is not None] if row else []


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", share: float = 0.01, hot: list | None = None) -> DataFrame:
    """`left` joined with `right`, hot keys of `left` split over salts. hot: those keys, where they are known already.

    `spread` is any well-distributed column of `left`. Only the hot keys' rows of `right` are copied, where
    it is unique on `key` at most salts/share rows in all. Null keys never match and are spread too, so they do not gather in one task.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"salted_join: {how}")
    hot = hot_keys(left, key, share) if hot is None else hot
    salts = min(256, max(8, shuffle_width(left.sparkSession)))
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    a = left.withColumn("_salt", F.when(F.col(key).isNull() | is_hot, salt).otherwise(F.lit(0)))
    b = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "_salt"], how).drop("_salt")
