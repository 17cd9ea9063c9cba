"""The same answer at every size: names of common words, lower trees, several automata, repeated rows, capitals."""

import random

import numpy as np
from pyspark.sql import functions as F

from vinculum.llm import contamination as C
from vinculum.llm import mixing as M
from vinculum.llm import names as W
from vinculum.llm import near_duplicates as N
from vinculum.llm import neighbours as V
from vinculum.llm import redaction as P

NAMES = "id string, type string, name string, canonical string"


def test_names_of_common_words_keep_their_links(spark):
    own = [(f"q{i}", "organization", n, None) for i, n in enumerate(["Pioneer Quarry Partners"] * 4 + ["Poineer Quarry Partners"])]
    rng = random.Random(2)
    made = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    others = [(f"o{i:03d}", "organization", f"{made()} {made()} {('Pioneer', 'Quarry', 'Partners')[i % 3]}", None) for i in range(240)]
    for rows in (own, own + others):
        got = {r["id"]: r["entity"] for r in W.link_names(spark.createDataFrame(rows, NAMES)).collect()}
        assert len({got[i] for i, *_ in own}) == 1
    assert sum(got[i] == got["q0"] for i in got) == len(own)


def test_bare_surnames_with_a_slip_and_taught_nicknames(spark):
    rows = [(f"f{i}", "person", "Karolina Nodawmane", None) for i in range(3)] + [("bare", "person", "Ms. Nodawmame", None)]
    rows += [("t1", "person", "Zuzi Fisorgo", "Susanna Fisorgo"), ("t2", "person", "Zuzi Verkadul", "Susanna Verkadul"), ("u1", "person", "Zuzi Komaltre", None), ("u2", "person", "Susanna Komaltre", None), ("u3", "person", "Susanna Komaltre", None)]
    got = {r["id"]: r["entity"] for r in W.link_names(spark.createDataFrame(rows, NAMES)).collect()}
    assert got["bare"] == got["f0"] and got["u1"] == got["u2"]


def test_minimum_of_matches_follows_the_threshold():
    assert N.least_matches(0.6, 60, 5) == 2 and N.least_matches(0.8, 60, 5) > 4
    assert N.missed(0.8, 60, 5, N.least_matches(0.8, 60, 5)) <= 1e-4 and N.missed(0.66, 60, 5, 2) < 0.004


def test_best_first_takes_the_best_leaves():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    f = V.Forest(x, 4, 3, [0])
    leaves, priority = f.search(x[:20], 10)
    assert (leaves[:, :3].max(axis=1) < 48).all() and (np.diff(priority, axis=1) <= 1e-6).all()
    assert all(set(a) >= set(b) for a, b in zip(leaves, f.own(x[:20])))
    every, all_p = f.search(x[:20], 1000)
    assert every.shape[1] == 48 and all(len(set(r)) == 48 for r in every) and np.allclose(np.sort(all_p, axis=1)[:, ::-1][:, :10], priority)


def test_lower_trees_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(0)
    n = 3000
    centre = rng.standard_normal((150, 16))
    x = centre[rng.integers(0, 150, n)] + 0.25 * rng.standard_normal((n, 16))
    df = spark.createDataFrame([(f"v{i:04d}", "a", v.tolist()) for i, v in enumerate(x)], "id string, kind string, vector array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"v{a:04d}", f"v{b:04d}") for a in range(0, n, 30) for b in np.argsort(-s[a])[:5] if s[a, b] >= 0.85}
    asked = F.substring("id", 2, 4).cast("int") % 30 == 0
    got = {tuple(r)[:2] for r in V.nearest(df, 5, dim=16, floor=0.85, queries=asked, leaf=32, sample=300).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_several_automata_give_what_one_gives(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(12)] + [(99, None), (98, "short one")]
    docs = [(i, " ".join(rng.choices(words, k=20)) + ". " + (items[i % 12][1] if i % 2 else "") + " end " + " ".join(rng.choices(words, k=40))) for i in range(20)] + [(50, None), (51, "")]
    d, t = spark.createDataFrame(docs + docs[:2], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    one, many = ({tuple(r) for r in C.find_leaks(d, t, shard_words=k).collect()} for k in (10**6, 60))
    assert one == many and len(one) == 10
    one, many = (sorted(map(str, C.remove_leaks(d, t, shard_words=k).collect())) for k in (10**6, 60))
    assert one == many and len(one) == 24


def test_mix_counts_repeated_rows_as_records(spark):
    docs = [(1, "a", "one two three")] * 2 + [(2, "a", "four five six"), (None, "a", None), (None, "a", "no id"), (3, None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    plan = spark.createDataFrame([("a", 1.0, 3), ("absent", 0.5, 2)], "source string, target_share double, max_repeats int")
    rows, (share,) = M.mix(d, plan).collect(), [r for r in M.shares(d, plan).collect() if r["source"] == "a"]
    assert len(rows) == share["copies_out"] and sum(r["tokens"] for r in rows) == share["tokens_out"]


def test_candidates_in_capitals_and_loose_signs():
    text = "SIGNED AND SWORN BEFORE ME BY PRIYA BAKISEZI, OF THE COUNTY OF HARWICK. git@build:x/y"
    spans = {(c[0], text[c[1] : c[2]]) for c in P.candidates(text)}
    assert (4, "PRIYA BAKISEZI") in spans and any(k == 0 for k, _ in spans)
    s = P.Sketch()
    s.add("priya", 5)
    assert s.get("priya") == 5 and s.get("bakisezi", 0) == 0
