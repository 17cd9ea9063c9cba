import random

import pytest

from vinculum.functions.similarity import ratio, token_set
from vinculum.operators import resolution as ER

WORDS = ["Harbor", "Harbour", "Summit", "Sumit", "Holdings", "Hldgs", "Inc", "The", "straße", "İzmir", "a", "a"]


def made(rng, n):
    return ["".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\t", " ", "-"]) for _ in range(rng.randrange(1, 6))).strip() for _ in range(n)]


def test_bounds_are_never_under_the_ratios():
    rng = random.Random(4)
    s, t = made(rng, 60) + ["", " ", "x"], made(rng, 60) + ["", "x x x"]
    indel, token = ER._may_match(s, t)
    assert all(indel[i, j] >= ratio(x, y) / 100 - 1e-9 and token[i, j] >= token_set(x, y) / 100 - 1e-9 for i, x in enumerate(s) for j, y in enumerate(t))


def test_few_pairs_are_computed_and_none_is_lost(spark, monkeypatch):
    """All records share a word, so all of them meet."""
    rng, names = random.Random(6), ["".join(random.Random(i).choice("bcdfghjklmnprstvwz") + random.Random(i + 1000).choice("aeiou") for _ in range(2)) for i in range(3)]
    one = lambda i: "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(4)) + rng.choice([" pioneer ", " pioneer  "]) + rng.choice(names)
    old = [one(i) for i in range(90)]
    new = [one(i) for i in range(60)] + [x[1:] for x in old[:20]] + [x.upper() for x in old[20:25]]
    schema = "entity_id string, entity_text string, entity_type string"
    frame = lambda texts, p: spark.createDataFrame([(f"{p}{i:03d}", t, "ORGANIZATION") for i, t in enumerate(texts)], schema)
    monkeypatch.setattr(ER, "LIST_RECORDS", 20, raising=False)
    want = {}
    for i, x in enumerate(new):
        for j, y in enumerate(old):
            v = (ratio(x.lower(), y.lower()) + token_set(x.lower(), y.lower())) / 200
            if v >= 0.85:
                want[f"n{i:03d}", f"o{j:03d}"] = v
    found = ER.near_matches(frame(new, "n"), frame(old, "o"), 0.85)
    got = {(r["entity_id"], r["match_id"]): r["similarity"] for r in found.collect()}
    assert len(want) >= 25 and set(got) == set(want) and got == pytest.approx(want)
    # the bounds leave a small share of the 7,650 pairs
    indel, token = ER._may_match([x.lower() for x in new], [x.lower() for x in old])
    assert (indel + token >= 1.7).mean() < 0.1
