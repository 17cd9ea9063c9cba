"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.operators.skew import salted_join
from vinculum.session import materialise


#: From so many edges on, hubs are looked for and their edges salted; below, any one task can hold them.
SALT_FROM = 1_000_000


def _star(edges: DataFrame, large: bool, salt: bool) -> DataFrame:
    """Every record's larger (or smaller) neighbours are hung on its smallest one."""
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = salted_join(sides, least, "a", F.col("b"), "inner") if salt else sides.join(least, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    hung = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any ordered type to (id, component), the component's smallest id.

    Loops and repeated edges do no harm, edges with a null end are left out; records without edges do not appear.
    The number of rounds grows with the logarithm of the component sizes. A hub's edges are salted.
    """
    ok = materialise(edges.select("a", "b").where("a is not null and b is not null").distinct())
    ends = ok.select(F.col("a").alias("id")).union(ok.select("b")).distinct()
    now = ok.where("a <> b")
    before = None
    while True:
        stamp = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if stamp == before:
            break
        before = stamp
        salt = stamp[0] >= SALT_FROM
        now = materialise(_star(materialise(_star(now, True, salt)), False, salt))
    return ends.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
