"""Parent-child links to full hierarchies.

Every record names at most one parent, so the links form trees and loops, and weighted disjoint sets resolve both: each
task leads the links it holds on to the last record it knows (root, offset and the path between, by a walk over its index
of parents), the shortened links are merged with those of the other tasks by a join that doubles every pointer, and what
is open is led on again, until it fits one bounded task.

Loops are found first. Up to `task_rows` open links one task's disjoint sets find them; above it pointers of equal,
doubling length do, since links led on by unequal steps keep to their loop but do not all lie on a ring any more, and
which records form the loop would be lost. With its smallest record cut out a loop is a chain, walked like any tree.

States: ``tree``, ``dangling`` (the topmost ancestor names a parent that does not exist), ``cycle`` (on a loop),
``below_cycle``. Blank parents are none. Of several states of one record the latest counts; of equal times the later
created one, then the greater parent. Records without id are left out. An empty table gives no rows.
An id may hold any character but U+0001.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.session import clean_id, materialise

#: Rows that one task may hold at once.
TASK_ROWS = 500_000

#: Between the ids of a path, inside; no id may hold it.
_SEP = "\x01"

_LINKS = "id string, ptr string, off int, seg string, loop string"


def current_links(df: DataFrame, node: str, parent: str, updated: str | None = None, created: str | None = None) -> DataFrame:
    """(id, parent): the current state of each record."""
    at = [(F.col(c) if c else F.lit(0)).alias(f"t{i}") for i, c in enumerate((updated, created))]
    rows = df.select(clean_id(node).alias("id"), clean_id(parent).alias("parent"), *at).where("id is not null")
    return rows.groupBy("id").agg(F.max(F.struct("t0", "t1", "parent")).alias("s")).select("id", F.col("s.parent").alias("parent"))


def compress(paths: bool):
    """A task's weighted disjoint-set forest: every link is led on to the last record reachable inside the task.

    seg: the ids after ptr down to id, with paths. loop: for a record on a loop, the loop's smallest id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=["id", "ptr", "off", "seg"])], ignore_index=True)
        if rows.empty:
            return
        at = {k: i for i, k in enumerate(rows["id"])}
        ptr, off, seg = rows["ptr"].tolist(), [int(x) for x in rows["off"]], rows["seg"].tolist()
        loop: list[str | None] = [None] * len(ptr)
        done = bytearray(len(ptr))  # 1: on the present walk, 2: compressed
        for start in range(len(ptr)):
            walk, i = [], start
            while i is not None and not done[i]:
                done[i] = 1
                walk.append(i)
                i = at.get(ptr[i])
            if i is not None and done[i] == 1:  # the walk met itself
                ring = walk[walk.index(i) :]
                least = min(rows["id"].iat[k] for k in ring)
                for k in ring:
                    loop[k], ptr[k], off[k], done[k] = least, rows["id"].iat[k], 0, 2
                walk = walk[: len(walk) - len(ring)]
            for k in reversed(walk):
                up = at.get(ptr[k])
                if up is not None and loop[up] is None:  # the forest's own roots keep their link out of the task
                    if paths:
                        seg[k] = f"{seg[up]}{_SEP}{seg[k]}"
                    off[k] += off[up]
                    ptr[k] = ptr[up]
                done[k] = 2
        yield pd.DataFrame({"id": rows["id"], "ptr": ptr, "off": off, "seg": seg, "loop": loop})

    return run


def _lead(links: DataFrame, ends: DataFrame, paths: bool, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """links (id, ptr, off, seg) led on to ends (id). Returns (id, root, off, seg) and the records on loops (id).

    With paths there must be no loops. Every join doubles the reach of all pointers, so after log2(n) rounds whatever has
    not come to an end goes round a loop, and its pointers lie on loops.
    """
    spark = links.sparkSession
    solved = ends.select("id", F.col("id").alias("root"), F.lit(0).alias("off"), F.lit("").alias("seg"))
    loops = spark.createDataFrame([], "id string")
    left = materialise(links)
    joined = F.when(F.col("b.seg") == "", F.col("a.seg")).otherwise(F.concat_ws(_SEP, "b.seg", "a.seg")) if paths else F.lit("")
    total = n = left.count()
    rounds = 0
    while n:
        if rounds > total.bit_length():
            return solved, loops.unionByName(left.select(F.col("ptr").alias("id")).distinct())
        tasks = -(-n // task_rows)
        packed = left.withColumn("loop", F.lit(None).cast("string"))
        if paths or tasks == 1:
            packed = materialise(left.repartition(tasks, "id").mapInPandas(compress(paths), _LINKS))
        rings = packed.where("loop is not null").select("id")
        loops = loops.unionByName(rings)
        solved = solved.unionByName(rings.select("id", F.col("id").alias("root"), F.lit(0).alias("off"), F.lit("").alias("seg")))
        open_ = packed.where("loop is null").select("id", "ptr", "off", "seg")
        known = solved.select("id", F.col("root").alias("to"), "off", "seg", F.lit(True).alias("ok")).unionByName(open_.select("id", F.col("ptr").alias("to"), "off", "seg", F.lit(False).alias("ok")))
        step = open_.alias("a").join(known.alias("b"), F.col("a.ptr") == F.col("b.id")).select("a.id", F.col("b.to").alias("ptr"), (F.col("a.off") + F.col("b.off")).alias("off"), joined.alias("seg"), "b.ok")
        step = materialise(step)
        solved = solved.unionByName(step.where("ok").select("id", F.col("ptr").alias("root"), "off", "seg"))
        left = step.where("not ok").drop("ok")
        n = left.count()
        rounds += 1
    return solved, loops


def _least_on_loop(ring: DataFrame, task_rows: int) -> DataFrame:
    """(id, ptr) of records on loops to (id, loop): the smallest id on the loop."""
    ring = materialise(ring.withColumn("loop", F.col("id")))
    n = ring.count()
    if n <= task_rows:
        links = ring.select("id", "ptr", F.lit(1).alias("off"), F.lit("").alias("seg"))
        return links.repartition(1).mapInPandas(compress(False), _LINKS).select("id", "loop")
    for _ in range(n.bit_length()):
        a, b = ring.alias("a"), ring.alias("b")
        ring = materialise(a.join(b, F.col("a.ptr") == F.col("b.id")).select("a.id", "b.ptr", F.least("a.loop", "b.loop").alias("loop")))
    return ring.select("id", "loop")


def _places(loops: DataFrame, edges: DataFrame, task_rows: int) -> DataFrame:
    """loops (id, loop) to (id, loop, place, size): the steps up to the loop's smallest record, and the loop's length."""
    first = loops.where("id = loop").select("id")
    chains = edges.join(loops.where("id <> loop").select("id"), "id", "left_semi").withColumn("seg", F.col("id"))
    place = materialise(_lead(chains, first, True, max(1, task_rows // 4))[0].select("id", F.col("root").alias("loop"), F.col("off").alias("place")))
    return place.join(place.groupBy("loop").agg((F.max("place") + 1).alias("size")), "loop").select("id", "loop", "place", "size")


def resolved(links: DataFrame, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, parent) to (id, state, root_id, depth, chain), the records on loops (id, loop) and the links (id, ptr, off, seg).

    chain: the ids from the root (of ``below_cycle`` from the first record on the loop) down to the record.
    """
    nodes = materialise(links.select("id", "parent"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    marked = materialise(nodes.join(known, "parent", "left").select("id", "parent", F.col("there").isNotNull().alias("linked")))
    ends = marked.where("not linked").select("id", F.col("parent").isNotNull().alias("dangling"))
    edges = marked.where("linked").select("id", F.col("parent").alias("ptr"), F.lit(1).alias("off"), F.lit("").alias("seg"))
    loops = _lead(edges, ends, False, task_rows)[1]
    loops = materialise(_least_on_loop(edges.join(loops.distinct(), "id", "left_semi").select("id", "ptr"), task_rows))
    tops = ends.select("id", F.when(F.col("dangling"), "dangling").otherwise("tree").alias("kind"), F.col("id").alias("root_id"))
    tops = tops.unionByName(loops.select("id", F.lit("below_cycle").alias("kind"), F.col("loop").alias("root_id")))
    # with the loops cut, what is left is a forest; it is walked for its paths
    inner = edges.join(loops.select("id"), "id", "left_anti").withColumn("seg", F.col("id"))
    walked, _ = _lead(inner, tops.select("id"), True, max(1, task_rows // 4))
    out = walked.join(tops.withColumnRenamed("id", "root"), "root")
    own = F.col("off") == 0
    state = F.when(own & (F.col("kind") == "below_cycle"), "cycle").otherwise(F.col("kind"))
    chain = F.when(own, F.array("id")).otherwise(F.concat(F.array("root"), F.split("seg", _SEP)))
    return out.select("id", state.alias("state"), "root_id", F.col("off").alias("depth"), chain.alias("chain")), loops, edges


def hierarchy(links: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, parent) to (id, state, root_id, depth, path).

    root_id of ``cycle`` and ``below_cycle`` is the smallest id on the loop; their depth counts the steps up to the loop,
    and their path starts at the first record on it.
    """
    return resolved(links, task_rows)[0].select("id", "state", "root_id", "depth", F.array_join("chain", "/").alias("path"))


def descendants(links: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, parent) to (ancestor_id, id, distance): every pair of a record and one below it, itself left out.

    All records of a loop are below one another, and what hangs below one of them is below all; distance counts the
    fewest steps up.
    """
    tree, loops, edges = resolved(links, task_rows)
    tree, loops = materialise(tree), _places(loops, edges, task_rows)
    up = tree.select("id", "depth", F.posexplode("chain").alias("pos", "ancestor_id"))
    pairs = up.where("ancestor_id <> id").select("ancestor_id", "id", (F.col("depth") - F.col("pos")).alias("distance"))
    first = tree.where("state in ('cycle', 'below_cycle')").select("id", "depth", F.col("chain")[0].alias("foot"))
    foot = first.join(loops.select(F.col("id").alias("foot"), "loop", "place", "size"), "foot")
    others = loops.select(F.col("id").alias("ancestor_id"), "loop", F.col("place").alias("there"))
    round_ = foot.join(others, "loop").where("ancestor_id <> foot").select("ancestor_id", "id", (F.col("depth") + F.pmod(F.col("place") - F.col("there"), F.col("size"))).cast("int").alias("distance"))
    return pairs.unionByName(round_)


def tree_report(tree: DataFrame) -> DataFrame:
    """Per root: how many records, the greatest depth, and how many of each state."""
    return tree.groupBy("root_id").agg(
        F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"),
        *(F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s}") for s in ("tree", "dangling", "cycle", "below_cycle")),
    )
