"""Most similar vectors for every vector: a forest of random-projection trees, searched through one shared priority queue.

A tree splits at the median of a sample along the difference of two of its vectors, down to leaves of about `leaf`
vectors, so its depth follows the number of vectors and a query meets as many candidates at any size. The upper levels
are fitted per type on a sample of at most `sample` vectors and broadcast; where more levels are asked for, every cell
of the upper trees gets its own lower tree, fitted in a task of its own on a share of the cell's vectors, and kept in a
table. Every vector is put into a leaf of every tree.

A query has one queue for all trees of its type. It holds nodes, ordered by the smallest margin to a split on the way
there; the best is taken, its two children are put back, and the first `probes` leaves that come up are read. A cell's
best leaf has the cell's own priority, so the cells that come up first hold the leaves that come up first; lower trees are
searched cell by cell, and the best leaves of all cells are taken.

Leaves meet their queries in blocks of bounded numbers of both, and the candidates are ranked again on the exact vectors.

Comparable vectors have `dim` finite values, not all zero; types are compared trimmed and lower-cased. Others, null ids
and null types take no part. Repeated rows count once; of one id with several vectors the greatest counts. Vectors of
equal direction (within 1e-5) are one class and searched once, so a hot group of copies does not fill a leaf. Ties go to
the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculum.operators.skew import salted_join
from vinculum.session import materialise

#: Vectors that the upper levels are fitted on, of all types together, and rows that a leaf is to hold.
SAMPLE, LEAF = 100_000, 256
#: Members and queries that one block of a leaf may hold, in numbers of LEAF; rows of a cell that one task searches.
MEMBERS, ASKING, CELL_ROWS = 16, 64, 50_000
#: Types that the driver may hold.
MAX_TYPES = 10_000
TREES, PROBES = 4, 12
#: Neighbours of a similarity of at least HIGH lie in few leaves. Under a lower floor they lie anywhere near: then there
#: are WIDE_TREES trees, and a query reads at least WIDE_SHARE of all leaves of its type, however many there are.
HIGH, WIDE_TREES, WIDE_SHARE = 0.85, 8, 0.15
#: More than twice the error of a similarity of half-precision vectors.
HALF = 0.004


def comparable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, kind, vector) to (id, kind, unit): unit as the bytes of float32."""
    rows = vectors.select("id", F.nullif(F.lower(F.btrim("kind", F.lit(" \t\r\n"))), F.lit("")).alias("kind"), F.col("vector").cast("array<float>").alias("vector"))
    ok = rows.where((F.size("vector") == dim) & F.col("id").isNotNull() & F.col("kind").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["vector"].tolist(), np.float64).reshape(-1, dim)
                x /= np.abs(x).max(axis=1, keepdims=True)  # else very long or short vectors overflow
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                cls = [hash_bytes(k, r) for k, r in zip(b["kind"], np.round(x * 1e5).astype(np.int32))]
                yield pd.DataFrame({"id": b["id"], "kind": b["kind"], "cls": cls, "unit": [r.tobytes() for r in x.astype(np.float32)]})

    out = ok.mapInPandas(unit, "id string, kind string, cls long, unit binary")
    return out.groupBy("id").agg(F.max(F.struct("kind", "cls", "unit")).alias("s")).select("id", "s.kind", "s.cls", "s.unit")


def hash_bytes(kind: str, row: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(kind.encode() + row.tobytes()) - 2**63


class Forest:
    """Trees of one depth in heap order: node i has children 2i+1 and 2i+2. Leaves are numbered over all trees."""

    def __init__(self, x: np.ndarray, depth: int, trees: int, seed: list[int]):
        self.depth, self.trees, self.inner = depth, trees, 2**depth - 1
        self.w, self.t = np.zeros((trees * self.inner, x.shape[1]), np.float32), np.zeros(trees * self.inner, np.float32)
        for k in range(trees):
            rng = np.random.default_rng([*seed, k])
            rows = [np.arange(len(x))]
            for level in range(depth):
                below = []
                for j, own in enumerate(rows):
                    i = k * self.inner + 2**level - 1 + j
                    pick = x[rng.choice(own, 2)] if len(own) > 1 else rng.standard_normal((2, x.shape[1]))
                    w = pick[0] - pick[1]
                    if not np.abs(w).max() > 1e-6:
                        w = rng.standard_normal(x.shape[1])
                    self.w[i] = w / np.linalg.norm(w)
                    m = x[own] @ self.w[i]
                    self.t[i] = np.median(m) if len(own) else 0
                    right = m > self.t[i]
                    below += [own[~right], own[right]]
                rows = below

    def own(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        node = np.zeros((len(x), self.trees), np.int64)
        for k in range(self.trees):
            for _ in range(self.depth):
                at = k * self.inner + node[:, k]
                node[:, k] = 2 * node[:, k] + 1 + (np.einsum("ij,ij->i", x, self.w[at]) > self.t[at])
        return node - self.inner + np.arange(self.trees) * 2**self.depth

    def search(self, x: np.ndarray, most: int, first: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Best first: of every vector the first `most` leaves (-1: there are no more) and their priorities.

        All vectors take one step at a time, each from its own queue. first: the priority of the roots.
        """
        n, per = len(x), 2 * self.inner + 1
        most = min(most, self.trees * 2**self.depth)
        queue, node = np.full((n, self.trees + 64), -np.inf, np.float32), np.zeros((n, self.trees + 64), np.int64)
        queue[:, : self.trees] = np.broadcast_to(np.asarray(first, np.float32).reshape(-1, 1), (n, self.trees))
        node[:, : self.trees] = np.arange(self.trees) * per
        length = np.full(n, self.trees)
        leaves, priority, got = np.full((n, most), -1, np.int64), np.full((n, most), -np.inf, np.float32), np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            size = int(length[live].max())
            if size == queue.shape[1]:
                queue = np.concatenate((queue, np.full(queue.shape, -np.inf, np.float32)), axis=1)
                node = np.concatenate((node, np.zeros_like(node)), axis=1)
            j = queue[live, :size].argmax(axis=1)
            p, v = queue[live, j], node[live, j]
            tree, local = v // per, v % per
            leaf = local >= self.inner
            a = live[leaf]
            leaves[a, got[a]], priority[a, got[a]] = tree[leaf] * 2**self.depth + local[leaf] - self.inner, p[leaf]
            got[a] += 1
            queue[a, j[leaf]] = -np.inf
            b, inner = live[~leaf], ~leaf
            if len(b):
                at = tree[inner] * self.inner + local[inner]
                m = np.einsum("ij,ij->i", x[b], self.w[at]) - self.t[at]
                left = v[inner] + local[inner] + 1
                near, margin = left + (m > 0), np.abs(m)
                queue[b, j[inner]], node[b, j[inner]] = np.minimum(p[inner], margin), near
                queue[b, length[b]], node[b, length[b]] = np.minimum(p[inner], -margin), 2 * left + 1 - near
                length[b] += 1
            live = live[(got[live] < most)]
        return leaves, priority


def depth_for(n: int, leaf: int) -> int:
    return int(np.ceil(np.log2(n / leaf))) if n > leaf else 0


def fit(sample: pd.DataFrame, counts: dict[str, int], dim: int, trees: int, leaf: int, seed: int) -> dict[str, tuple[Forest, int]]:
    """Per type the upper trees, as deep as its number of vectors asks for and its sample allows, and how many levels they lack."""
    out = {}
    for kind, n in counts.items():
        own = sample.loc[sample["kind"] == kind, "unit"]
        x = np.frombuffer(b"".join(own), np.float32).reshape(-1, dim)
        want = depth_for(n, leaf)
        depth = max(0, min(want, int(np.log2(max(1, len(x) / 8)))))
        # a type that is searched whole needs one tree
        out[kind] = Forest(x, depth, trees if want else 1, [seed]), want - depth
    return out


def _leaves_to_read(forest: Forest, lack: int, probes: int, share: float) -> int:
    every = forest.trees * 2 ** (forest.depth + lack)
    return min(max(probes, forest.trees, int(np.ceil(share * every))), every)


_ROUTED = "leaf string, cls long, unit binary, priority float, member boolean, asks boolean, most int"


def _route(forest, dim: int, probes: int, share: float):
    """(cls, kind, unit, asked) to the cells of the upper trees that it belongs to or reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for kind, b in whole.groupby("kind", sort=False):
                f, lack = forest.value[kind]
                most = _leaves_to_read(f, lack, probes, share)
                for i in range(0, len(b), 512):
                    part = b.iloc[i : i + 512]
                    x = np.frombuffer(b"".join(part["unit"]), np.float32).reshape(-1, dim)
                    cls, asked = part["cls"].to_numpy(), part["asked"].to_numpy().astype(bool)
                    who, at, priority, member = _visits(f, x, asked, most, np.inf)
                    half = x.astype(np.float16)
                    yield pd.DataFrame({
                        "leaf": [f"{kind}/{a}" for a in at], "cls": cls[who], "unit": [half[r].tobytes() for r in who],
                        "priority": priority, "member": member, "asks": asked[who], "most": np.full(len(who), most, np.int32),
                    })

    return run


def _visits(f: Forest, x: np.ndarray, asked: np.ndarray, most: int, first: np.ndarray | float):
    """Rows (vector, leaf, priority, member): of every vector its own leaves, of those that ask the leaves they read."""
    own = f.own(x)
    n, rows = len(x), np.flatnonzero(asked)
    first = np.broadcast_to(np.asarray(first, np.float32), (n,))
    leaves, priority = f.search(x[rows], most, first[rows])
    seen = (leaves[:, :, None] == own[rows][:, None, :]).any(axis=2) | (leaves < 0)
    q, k = np.nonzero(~seen)
    who = np.concatenate((np.repeat(np.arange(n), f.trees), rows[q]))
    at = np.concatenate((own.ravel(), leaves[q, k]))
    return who, at, np.concatenate((np.repeat(first, f.trees), priority[q, k])), np.arange(len(who)) < n * f.trees


def _deepen(routed: DataFrame, kinds: dict[str, int], dim: int, leaf: int, seed: int) -> DataFrame:
    """Cells that lack levels (kinds: type to levels) are split by lower trees of their own, and these searched."""
    lack = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    routed = materialise(routed.withColumn("lack", F.coalesce(F.try_element_at(lack, F.regexp_replace("leaf", "/[0-9]+$", "")), F.lit(0))))
    flat, deep = routed.where("lack = 0"), routed.where("lack > 0")
    # sixteen vectors a leaf teach where to split
    some = deep.where(F.col("member") & (F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(leaf)) < 16)).select("leaf", "unit", "lack")

    def learn(b: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(b["unit"]), np.float16).reshape(-1, dim).astype(np.float32)
        f = Forest(x, int(b["lack"].iat[0]), 1, [seed, len(x)])
        return pd.DataFrame({"leaf": [b["leaf"].iat[0]], "w": [f.w.tobytes()], "t": [f.t.tobytes()]})

    lower = materialise(some.groupBy("leaf").applyInPandas(learn, "leaf string, w binary, t binary"))
    parts = materialise(deep.groupBy("leaf").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("n")))
    dealt = deep.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))
    trees = lower.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def walk(b: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _ROUTED.split(", ")]
        if b.empty:
            return pd.DataFrame(columns=columns)
        x = np.frombuffer(b"".join(b["unit"]), np.float16).reshape(-1, dim).astype(np.float32)
        depth = int(b["lack"].iat[0]) if len(tree) else 0  # a cell without a sample stays whole
        f = Forest(x[:0], 0, 1, [seed])
        if depth:
            f.depth, f.inner = depth, 2**depth - 1
            f.w, f.t = np.frombuffer(tree["w"].iat[0], np.float32).reshape(-1, dim), np.frombuffer(tree["t"].iat[0], np.float32)
        cls, unit, asks, is_member, first = (b[c].to_numpy() for c in ("cls", "unit", "asks", "member", "priority"))
        out, most = [], int(b["most"].iat[0])
        for i in range(0, len(b), 512):
            s = slice(i, i + 512)
            who, at, priority, own = _visits(f, x[s], asks[s].astype(bool), most, first[s])
            # a cell that is only read has no members of this vector
            member = own & is_member[s][who].astype(bool)
            keep = member | asks[s][who].astype(bool)
            who, at = who[keep] + i, at[keep]
            out.append(pd.DataFrame({"leaf": [f"{b['leaf'].iat[0]}/{a}" for a in at], "cls": cls[who], "unit": unit[who], "priority": priority[keep], "member": member[keep], "asks": asks[who], "most": np.full(len(who), most, np.int32)}))
        return pd.concat(out, ignore_index=True)[columns]

    walked = dealt.drop("n").groupBy("leaf", "part").cogroup(trees.drop("n").groupBy("leaf", "part")).applyInPandas(walk, _ROUTED)
    by = Window.partitionBy("cls").orderBy(F.desc("priority"), "leaf")
    # one queue over all cells: the best leaves of all of them
    kept = walked.withColumn("r", F.row_number().over(by)).withColumn("asks", F.col("asks") & (F.col("r") <= F.col("most"))).where("asks or member").drop("r")
    return flat.drop("lack").unionByName(kept)


def _blocks(routed: DataFrame, leaf: int) -> DataFrame:
    """Leaves in blocks: members dealt over m, queries over q, every part of the one meets every part of the other."""
    per = routed.groupBy("leaf").agg(F.ceil(F.count(F.when(F.col("member"), 1)) / (MEMBERS * leaf)).cast("int").alias("km"), F.ceil(F.count(F.when(F.col("asks"), 1)) / (ASKING * leaf)).cast("int").alias("kq"))
    big = per.where("km > 1 or kq > 1")
    one = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    rows = routed.join(big, "leaf", "left").withColumns({"km": one("km"), "kq": one("kq")})
    rows = rows.withColumn("m0", F.pmod(F.xxhash64("cls"), F.col("km")).cast("int")).withColumn("q0", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("kq")).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_member = F.transform(upto("kq"), lambda q: F.struct(F.col("m0").alias("m"), q.alias("q"), F.col("member").alias("member"), (F.col("asks") & (q == F.col("q0"))).alias("asks")))
    as_query = F.transform(F.filter(upto("km"), lambda m: m != F.col("m0")), lambda m: F.struct(m.alias("m"), F.col("q0").alias("q"), F.lit(False).alias("member"), F.col("asks").alias("asks")))
    cells = F.explode(F.filter(F.concat(as_member, as_query), lambda c: c["member"] | c["asks"]))
    return rows.select("leaf", "cls", "unit", cells.alias("c")).select("leaf", "c.m", "c.q", "cls", "unit", "c.member", "c.asks")


def _meet(dim: int, k: int, floor: float):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(b["unit"]), np.float16).reshape(-1, dim).astype(np.float32)
        cls, member, asks = b["cls"].to_numpy(), b["member"].to_numpy(), b["asks"].to_numpy()
        m, mc = x[member], cls[member]
        out_a, out_b, out_s = [], [], []
        asking = np.flatnonzero(asks)
        for i in range(0, len(asking) if len(mc) else 0, 1024):
            at = asking[i : i + 1024]
            s = x[at] @ m.T
            s[cls[at][:, None] == mc[None, :]] = -2
            if s.shape[1] > 2 * k:  # a few more than k, for half precision
                low = np.partition(s, -2 * k, axis=1)[:, -2 * k]
                s[s < low[:, None]] = -2
            q, c = np.nonzero(s >= max(floor - HALF, -1.5))
            out_a.append(cls[at][q]), out_b.append(mc[c]), out_s.append(s[q, c])
        cat = lambda y, t: np.concatenate(y) if y else np.empty(0, t)
        return pd.DataFrame({"a": cat(out_a, np.int64), "b": cat(out_b, np.int64), "near": cat(out_s, np.float32)})

    return run


def _dot(dim: int):
    @F.pandas_udf("double")
    def dot(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(s), np.float32).reshape(-1, dim).astype(np.float64) for s in (a, b))
        return pd.Series(np.clip((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), -1, 1))

    return dot


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, floor: float = -1.0, queries: Column | None = None, trees: int | None = None, probes: int | None = None, leaf: int = LEAF, seed: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(id, kind, vector) to (id, other_id, similarity): for each query its k most similar others of the same kind.

    Only neighbours of a similarity of at least `floor` count. queries: which ids ask (all, if not given); every vector
    is searched. trees, probes: by the floor, if not given.
    """
    wide = floor < HIGH
    share = WIDE_SHARE if wide and probes is None else 0.0
    trees, probes = trees or (WIDE_TREES if wide else TREES), probes or PROBES
    units = materialise(comparable(vectors, dim).withColumn("asked", queries if queries is not None else F.lit(True)))
    reps = units.groupBy("cls").agg(F.min("kind").alias("kind"), F.min("unit").alias("unit"), F.bool_or("asked").alias("asked"))
    reps = materialise(reps)
    counts = {r["kind"]: r["n"] for r in reps.groupBy("kind").agg(F.count("*").alias("n")).limit(MAX_TYPES + 1).collect()}
    if len(counts) > MAX_TYPES:
        raise ValueError(f"nearest: at most {MAX_TYPES} types")
    spark = vectors.sparkSession
    if not counts:
        return spark.createDataFrame([], "id string, other_id string, similarity double")
    n = sum(counts.values())
    low = F.pmod(F.xxhash64("cls", F.lit(seed + 1)), F.lit(1 << 40)) < int(min(1.0, sample / n) * (1 << 40))
    fitted = fit(reps.select("kind", "unit").where(low).limit(2 * sample).toPandas(), counts, dim, trees, leaf, seed)
    forest = spark.sparkContext.broadcast(fitted)
    routed = reps.mapInPandas(_route(forest, dim, probes, share), _ROUTED)
    lacking = {kind: lack for kind, (_, lack) in fitted.items() if lack}
    routed = _deepen(routed, lacking, dim, leaf, seed) if lacking else routed
    blocks = _blocks(materialise(routed.select("leaf", "cls", "unit", "member", "asks")), leaf)
    met = blocks.groupBy("leaf", "m", "q").applyInPandas(_meet(dim, k, floor), "a long, b long, near float")
    if wide:  # many leaves bring many candidates; only those that may be among the k nearest are ranked on exact vectors
        by = Window.partitionBy("a").orderBy(F.desc("near")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = met.groupBy("a", "b").agg(F.max("near").alias("near")).withColumn("kth", F.nth_value("near", k).over(by)).where(F.col("near") >= F.coalesce("kth", F.lit(-2.0)) - HALF)
    met = materialise(met.select("a", "b").distinct())
    r = lambda c: reps.select(F.col("cls").alias(c), F.col("unit").alias(f"u{c}"))
    scored = met.join(r("a"), "a").join(r("b"), "b").select("a", "b", _dot(dim)("ua", "ub").alias("s")).where(F.col("s") >= floor)
    # of a class the k+1 smallest ids are enough to fill any list
    few = units.select("cls", "id").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = materialise(few)
    own = few.select(F.col("cls").alias("a"), F.col("ids").alias("own"))
    near = scored.join(few.withColumnRenamed("cls", "b"), "b").join(own, "a").where(F.size("own") <= k)
    near = near.select("a", "s", "own", F.explode("ids").alias("other")).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "other")))
    near = near.where(F.col("r") <= k - F.size("own") + 1).groupBy("a").agg(F.collect_list(F.struct("other", "s")).alias("near"))
    lists = own.join(near, "a", "left").select(F.col("a").alias("cls"), "own", "near")
    asking = units.where("asked").select("cls", "id")
    got = salted_join(asking, lists, "cls", F.col("id"), "inner")
    copies = F.transform(F.slice(F.filter("own", lambda x: x != F.col("id")), 1, k), lambda x: F.struct(x.alias("other"), F.lit(1.0).alias("s")))
    both = F.concat(copies, F.coalesce("near", F.array().cast("array<struct<other:string,s:double>>")))
    return got.select("id", F.explode(both).alias("x")).select("id", F.col("x.other").alias("other_id"), F.col("x.s").alias("similarity"))


def similar_pairs(vectors: DataFrame, floor: float, k: int = 5, **how) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of a similarity of at least `floor` of which one is among the k nearest of the other."""
    near = nearest(vectors, k, floor=floor, **how)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()
