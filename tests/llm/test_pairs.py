"""Near duplicates, names and neighbours against brute force, with nulls, copies, ties and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vinculum.llm import names as W
from vinculum.llm import near_duplicates as N
from vinculum.llm import neighbours as V

TEXTS = "kind int, id string, text string, key string, cls string"


def sets(text, n):
    w = N.words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for b in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 160))]
        for v in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(v * 2):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(vocab)], [w[i], "extra"]])
            rows.append((v % 2, f"d{b:02d}{v}", " ".join(w), "k", "c"))
    rows += [(0, "copy", rows[0][2].upper() + "!", "k", "c"), (0, "copy2", rows[0][2], "k", "c"), rows[0], (0, "nul", None, "k", "c"), (0, "empty", "", "k", "c"), (0, "short", "a b c", "k", "c"), (0, "long", "z " + " ".join(vocab * 3), "k", "c"), (0, None, "x", "k", "c")]
    return rows


def brute(rows, n, t, least):
    docs = {(k, i): sets(x, n) for k, i, x, *_ in rows if i and x and len(N.words(x)) >= least}
    keys = sorted(docs)
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and (u := docs[a] | docs[b]) and len(docs[a] & docs[b]) >= t * len(u)}


@pytest.mark.parametrize("n,t", [(3, 0.6), (5, 0.8)])
def test_pairs_equal_brute_force(spark, texts, n, t):
    got = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(texts, TEXTS), n, t, 40).collect()}
    want = brute(texts, n, t, 40)
    assert want and got <= want and len(want - got) <= 0.02 * len(want)


def test_groups_keep_every_link(spark, texts):
    df = spark.createDataFrame(texts, TEXTS)
    groups = {(r["kind"], r["id"]): r for r in N.near_duplicate_groups(df, 3, 0.6).collect()}
    for k, a, b in N.near_duplicate_pairs(df, 3, 0.6).collect():
        assert groups[k, a]["group_id"] == groups[k, b]["group_id"]
    assert groups[0, "copy"]["n_copies"] == 3 and "short" not in {i for _, i in groups}


def test_hot_lists_and_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted({(int(k), int(c)) for k, c in zip(rng.integers(0, 6, 900), rng.integers(0, 200, 900))} | {(99, 1), (99, 2)})
    k, c = (np.array(x, np.int64) for x in zip(*rows))
    cuts = [0, 7, 300, 301, len(k)]
    batches = [pa.RecordBatch.from_arrays([pa.array(k[a:b]), pa.array(c[a:b])], ["key", "cls"]) for a, b in zip(cuts, cuts[1:])]
    out = [x for y in N._pairs(20)(iter(batches)) for x in y.to_pylist()]
    assert [(x["a"], x["b"]) for x in out if x["b"] is not None] == [(1, 2)]
    assert sorted((x["key"], x["a"]) for x in out if x["b"] is None) == [r for r in rows if r[0] < 6]


def test_hot_lists_are_paired(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, f"x{i:02d}", " ".join([*base, f"own{i}"]), "k", "c") for i in range(12)]
    assert N.near_duplicate_pairs(spark.createDataFrame(rows, TEXTS), 3, 0.6).count() == 66


def test_empty_texts(spark):
    none = spark.createDataFrame([], TEXTS)
    assert N.near_duplicate_pairs(none).count() == 0 and N.near_duplicate_groups(none).count() == 0


NAMES = "id string, type string, name string, canonical string, kind string, form string"


def entities(spark, rows):
    df = spark.createDataFrame([(i, t, n, c, "x", "y") for i, t, n, c in rows], NAMES)
    return {r["id"]: r["entity"] for r in W.link_names(df).collect()}


def test_names(spark):
    people = [("1", "person", "Katherine Nodawamme", None), ("2", "person", "NODAWAMME Katherine", None), ("3", "judge", "Nodawamme, Kate", None), ("4", "person", "Katherine Nodáwamme, Esq.", "K. Nodawamme"), ("5", "person", "K. Nodawamme", None), ("6", "person", "Ms. Nodawamme", "Katherine Nodawamme"),
              ("7", "person", "Katherine Nodawmame", None), ("8", "person", "Katherine Nodawamme", None), ("9", "person", "Walter Nodawamme", None),
              ("a", "person", "Gerald Soglemagi, Jr.", None), ("b", "person", "Gerald Soglemagi Sr.", None), ("c", "person", "Jerry Soglemagi Jr", None), ("n", "person", None, None), ("e", "person", "", "  "), ("p", "date", "Katherine Nodawamme", None)]
    got = entities(spark, people)
    assert len({got[i] for i in "12345678"}) == 1 and got["9"] != got["1"]
    assert got["a"] == got["c"] != got["b"] and not {"n", "e", "p"} & set(got)


def test_organisations(spark):
    rows = [("1", "Lumpurenza Pioneer Holdings 2004 LLC"), ("2", "Pioneer Hldgs. Lumpurenza 2004"), ("3", "The Lumpurenza-Pioneer Holdings 2004, L.L.C."), ("4", "Lumpurenza Pioneer Holdings 2014 LLC"), ("5", "Lumpurenza Poineer Holdings 2004"), ("6", "Korzogumwo Harvest"), ("7", "Korzogumwo Harvest Technologies Co."),
            ("8", "Zorgu Summit Series A"), ("9", "Zorgu Summit Series B")]
    got = entities(spark, [(i, "organization", n, None) for i, n in rows])
    assert len({got[i] for i in "1235"}) == 1 and got["4"] != got["1"] and got["6"] == got["7"] and got["8"] != got["9"]
    df = spark.createDataFrame(list(got.items()), "id string, entity string")
    assert ("1", "2") in {tuple(r) for r in W.linked_pairs(df).collect()}


def test_no_names(spark):
    assert entities(spark, []) == {}


@pytest.mark.parametrize("a,b,d", [("abcd", "abcd", 0), ("abcd", "abdc", 1), ("abcd", "abc", 1), ("abcd", "axcy", 2), ("abcdef", "a", 3), ("", "ab", 2)])
def test_distance(a, b, d):
    assert W.distance(a, b) == W.distance(b, a) == d


def vectors(spark, rows):
    return spark.createDataFrame([(i, k, v, 1, "u") for i, k, v in rows], "id string, kind string, vector array<float>, cls int, unit string")


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    x[450:600] = x[:150] + 0.2 * rng.standard_normal((150, 16))
    rows = [(f"v{i:03d}", " Chunk" if i % 2 else "chunk ", [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [("n", "chunk", None), ("z", "chunk", [0.0] * 16), ("s", "chunk", [1.0] * 3), ("q", "chunk", [float("nan")] * 16), ("e", "chunk", []), ("k", None, [1.0] * 16)]
    near = V.nearest(vectors(spark, rows + bad + rows[:5]), 5, dim=16, leaf=64, trees=5, probes=14)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], set()).add(r["other_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {f"v{i:03d}": {f"v{j:03d}" for j in np.argsort(-s[i])[:5]} for i in range(900)}
    recall = sum(len(want[k] & got.get(k, set())) for k in want) / 4500
    assert recall >= 0.9 and set(got) == set(want) and all(len(v) == 5 for v in got.values())
    pairs = {tuple(r) for r in V.similar_pairs(vectors(spark, rows), 0.85, dim=16, leaf=64).collect()}
    true = {(min(a, b), max(a, b)) for a in want for b in want[a] if s[int(a[1:]), int(b[1:])] >= 0.85}
    assert len(true & pairs) >= 0.97 * len(true) and len(pairs - true) <= 0.03 * len(true)


def test_low_floor_keeps_recall_as_leaves_grow(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.standard_normal((n, 64)).astype(np.float32)
    rows = [(f"v{i:04d}", "chunk", v) for i, v in enumerate(x.tolist())]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = V.nearest(vectors(spark, rows), 5, queries=F.col("id").endswith("0"), leaf=64).collect()
    got = {}
    for r in near:
        got.setdefault(int(r["id"][1:]), set()).add(int(r["other_id"][1:]))
    s = u[::10] @ u.T
    s[np.arange(n // 10), np.arange(0, n, 10)] = -2
    want = {10 * i: set(np.argsort(-s[i])[:5].tolist()) for i in range(n // 10)}
    assert set(got) == set(want) and sum(len(want[i] & got[i]) for i in want) >= 0.9 * 5 * len(want)


def test_copies_of_one_vector(spark):
    rows = [(f"c{i:02d}", "x", [1.0, 2.0]) for i in range(20)] + [("far", "x", [2.0, -1.0]), ("other", "y", [1.0, 2.0])]
    got = [tuple(r) for r in V.nearest(vectors(spark, rows), 3, dim=2, floor=0.5).select("id", "other_id").collect()]
    assert len(got) == 60 and {b for a, b in got if a == "c00"} == {"c01", "c02", "c03"} and {b for a, b in got if a == "c19"} == {"c00", "c01", "c02"}
    assert V.nearest(vectors(spark, []), 3, dim=2).count() == 0
    one = V.nearest(vectors(spark, rows), 2, dim=2, queries=F.col("id") == "far").collect()
    assert {r["id"] for r in one} == {"far"}
