"""near_matches() has every pair of a type that is at the threshold, whatever words the two share."""

import random

import numpy as np
import pytest

from vinculum.functions.similarity import lcs, lcs_pairs, ratio, token_set
from vinculum.operators import build as B
from vinculum.operators import resolution as ER

SCHEMA = "entity_id string, entity_text string, entity_type string"


def sim(x, y):
    return (ratio(x.lower(), y.lower()) + token_set(x.lower(), y.lower())) / 200


def brute(new, old, threshold):
    return {(i, j): v for i, x in enumerate(new) for j, y in enumerate(old) if (v := sim(x, y)) >= threshold}


def odd(rng, n):
    words = ["Harborlight", "harborlite", "Summit", "sumit", "AB", "a", "İzmir", "straße", "--", "Inc", "the", "x" * 40, "x" * 30 + "y"]
    return ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "-", " "]) for _ in range(rng.randrange(1, 6))) for _ in range(n)] + ["", " ", "---", "...", "aa aa"]


def test_no_pair_at_the_threshold_is_lost():
    rng = random.Random(7)
    new, old = [t.lower() for t in odd(rng, 120)], [t.lower() for t in odd(rng, 110)]
    for threshold in (0.4, 0.5, 0.7, 0.85, 0.95, 1.0):
        want = brute(new, old, threshold)
        assert want and {(i, j): v for i, j, v in ER._near(new, old, threshold)} == want


def test_common_subsequences_of_many_pairs():
    rng = random.Random(3)
    one = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    left, right = [one(n) for n in (0, 1, 5, 63, 64, 65, 90, 30)], [one(n) for n in (0, 2, 64, 130, 17, 65)]
    i, j = (x.ravel() for x in np.meshgrid(range(len(left)), range(len(right)), indexing="ij"))
    assert lcs_pairs(left, right, i, j).tolist() == [lcs(left[a], right[b]) for a, b in zip(i, j)]
    assert lcs_pairs(left, right, i[:0], j[:0]).tolist() == []


def test_records_without_a_common_word_match(spark, monkeypatch):
    """A slip in every word, words that many others have, and one word only: none was found under its rarest words."""
    old = ["Harborlight Quarrying", "Quorhazare Summit Holdings", "Massingberdstone"] + [f"{w} Summit" for w in ("Quorhazare", "Quorhazara")] + [f"Holdings {i}" for i in range(9)]
    new = ["Harborlights Quarryings", "Quorhazarre Summit Holdings", "Massingberdstones", "Wholly Other"]
    frame = lambda texts, p, kind: spark.createDataFrame([(f"{p}{i}", t, kind) for i, t in enumerate(texts)], SCHEMA)
    known = frame(old, "o", "PARTY").union(frame(old, "c", "COURT"))
    want = {(f"n{i}", f"o{j}"): v for (i, j), v in brute(new, old, 0.85).items()}
    assert {("n0", "o0"), ("n1", "o1"), ("n2", "o2")} <= set(want)
    for size in (3, 4_000):  # lists of any length give the same pairs
        monkeypatch.setattr(ER, "LIST_RECORDS", size)
        monkeypatch.setattr(ER, "TILE_RECORDS", 2 if size == 3 else 2_000, raising=False)
        got = {(r["entity_id"], r["match_id"]): r["similarity"] for r in ER.near_matches(frame(new, "n", "PARTY"), known, 0.85).collect()}
        assert set(got) == set(want) and got == pytest.approx(want)


def test_upsert_merges_a_record_without_a_common_word(spark):
    schema = "entity_text string, entity_type string, confidence double, document_ids array<string>, attributes map<string,string>"
    old, new = spark.createDataFrame([("Massingberdstone", "PARTY", 0.6, ["d1"], None)], schema), spark.createDataFrame([("Massingberdstones", "PARTY", 0.9, ["d2"], None)], schema)
    (got,) = B.upsert_entities(new, old).collect()
    assert (got["entity_text"], got["action"], got["merge_count"], got["document_ids"]) == ("Massingberdstone", "merged", 1, ["d1", "d2"])
