"""Contamination, mixing, splitting and redaction."""

import random

import pytest

from vinculum.llm import boosting
from vinculum.llm import contamination as C
from vinculum.llm import mixing as M
from vinculum.llm import redaction as P
from vinculum.llm import splitting as S
from vinculum.llm.tokens import TOKENIZER, encoding

DOCS = "doc_id long, text string, source string, tokens int, copies string"


def grams(text, n):
    w = C.words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(25)] + ["Été", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "w1 w2")]
    items.append((93, items[3][1]))
    docs = []
    for d in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        w = (rng.choice(items)[1] or "").split()
        if w:
            a = rng.randrange(len(w))
            t[len(t) // 2 : len(t) // 2] = w[a:]
        docs.append((d, "- ".join(t).upper() if d % 3 else ", ".join(t), "s", 1, "c"))
    docs += [(100, None, "s", 1, "c"), (101, "", "s", 1, "c"), docs[0], (102, " ".join(i[1] or "" for i in items) * 3, "s", 1, "c")]
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id int, item_text string")
    for n, shard in ((5, 1_000_000), (5, 200), (13, 1_000_000)):
        want = {(d, i) for d, t, *_ in docs if t for i, x in items if x and grams(t, n) & grams(x, n)}
        got = {(r["doc_id"], r["item_id"]): r["longest"] for r in C.find_leaks(df, it, n, shard).collect()}
        assert set(got) == want and want
        for (d, i), m in list(got.items())[:60]:
            t, x = dict((a[0], a[1]) for a in docs)[d], dict(items)[i]
            assert grams(t, m) & grams(x, m) and not grams(t, m + 1) & grams(x, m + 1)


def test_removal(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, f"Before one. {item.upper()}! And after it all stands here as it was, nothing more and nothing less to read or to say.", "s", 1, "c"), (2, "clean", "s", 1, "c"), (3, item, "s", 1, "c"), (4, None, "s", 1, "c")]
    got = {r["doc_id"]: r for r in C.remove_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], "item_id int, item_text string")).collect()}
    assert got[1]["text"].startswith("Before one. ! And") and got[1]["leaked_words"] == 20 and not got[1]["dropped"]
    assert got[2]["text"] == "clean" and got[3]["dropped"] and got[3]["text"] is None and got[4]["text"] is None
    empty = spark.createDataFrame([], "item_id int, item_text string")
    assert C.find_leaks(spark.createDataFrame(docs, DOCS), empty).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, "word " * rng.randrange(1, 60), "big" if i % 3 else "small", 1, "c") for i in range(900)] + [(5000, None, "big", 1, "c"), (5001, "x", None, 1, "c"), (5002, "x", "unplanned", 1, "c")]
    plan = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, DOCS)
    drawn, rates = M.draw(df, plan, seed=1)
    rows = drawn.collect()
    rate = {r["source"]: r["rate"] for r in rates}
    assert rate["absent"] == 0.0 and len(rows) == 901
    for r in rows:
        assert int(rate[r["source"]]) <= r["copies"] <= int(rate[r["source"]]) + 1
    for r in M.shares(df, plan, seed=1).collect():
        if r["source"] != "absent":
            assert r["tokens_out"] == pytest.approx(r["tokens_wanted"], rel=0.02) and r["most_copies"] <= r["max_repeats"] and r["reached"]
    assert M.mix(df, plan, seed=1).count() == sum(r["copies"] for r in rows)
    assert sorted(tuple(r) for r in M.draw(df, plan, seed=1)[0].collect()) == sorted(map(tuple, rows))
    capped = {r["source"]: r["copies_out"] for r in M.shares(df, plan, total_tokens=10**9).collect()}
    assert capped["small"] == 600 and capped["big"] == 601
    assert M.mix(spark.createDataFrame([], DOCS), plan).count() == 0


def test_splitting(spark):
    rng = random.Random(3)
    plain = "\n\n".join(" ".join("Word and more words." for _ in range(rng.randrange(3, 9))) for _ in range(30))
    odd = ["x" * 3000, "承租人认为货物在运输途中毁损，依照前述证据。" * 40, "👩‍👩‍👧" * 60, "a b\n" * 400, "", None, "short", "one two three four five six seven eight nine"]
    docs = [(i, t, "s", 1, "c") for i, t in enumerate([plain, *odd])]
    enc, _ = encoding(TOKENIZER)
    for limit, overlap in ((50, 8), (50, 0), (8, 3)):
        lim = spark.createDataFrame([("s", limit, overlap), (None, 5, 1)], "source string, max_tokens int, overlap_tokens int")
        out = {}
        for r in S.split_oversized(spark.createDataFrame(docs, DOCS), lim).collect():
            out.setdefault(r["doc_id"], []).append(r)
        assert set(out) == {i for i, t, *_ in docs if t and len(enc.encode_ordinary(t)) > limit}
        for d, pieces in out.items():
            pieces.sort(key=lambda r: r["piece_no"])
            text = docs[d][1]
            assert pieces[0]["start_pos"] == 0 and pieces[-1]["end_pos"] == len(text) and len(pieces) == pieces[0]["n_pieces"]
            for p in pieces:
                assert p["text"] == text[p["start_pos"] : p["end_pos"]] and p["tokens"] == len(enc.encode_ordinary(p["text"]))
                assert p["tokens"] <= limit or len(p["text"]) == 1
            for p, q in zip(pieces, pieces[1:]):
                assert p["start_pos"] < q["start_pos"] <= p["end_pos"] < q["end_pos"] and (d == 3 or (q["start_pos"] < p["end_pos"]) == (overlap > 0))
    ends = [p["text"][-2:] for p in S.split_oversized(spark.createDataFrame(docs[:1], DOCS), spark.createDataFrame([("s", 50, 0)], "source string, max_tokens int, overlap_tokens int")).collect()]
    assert sum(e in ("\n\n", "s.", ". ") for e in ends) >= 0.9 * len(ends)


def personal(seed, n):
    """Texts with known items, in words the rules know only in part."""
    rng = random.Random(seed)
    given, sur = ["Priya", "Goran", "Walter", "Klara", "Helmut", "Zofia"], ["Tefovosku", "Bakisezi", "Lipatagi", "Vubaluna", "Mostomuko", "Kirezindu"]
    out = []
    for i in range(n):
        g, s = rng.choice(given), rng.choice(sur)
        mail, phone, ssn = f"{g.lower()}.{s.lower()}@post.invalid", f"({rng.randrange(200, 900)}) 555-01{rng.randrange(10, 99)}", f"9{rng.randrange(10, 99)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
        house = f"{rng.randrange(10, 9999)} Vesper {rng.choice(['St.', 'Lane', 'Drive'])}"
        parts = [("From: ", None), (f"{g} {s}", "name"), (" <", None), (mail, "email"), (">\nThe receiver argued that the lien survives. See Harwick v. Thornebury, 555 Rptr. 3d 81.\n", None), (rng.choice(["Daytime number ", "Phone: "]), None), (phone, "phone"), (". ", None),
                 (rng.choice(["He was SSN ", "Enclosed: SSN "]), None), (ssn, "id_number"), (f" without more. The invoice numbered {rng.randrange(1000, 9999)}-12-{rng.randrange(1000, 9999)} from Marchbane Textiles Ltd. totals $3,000.00.\nYesterday ", None), (f"{g} {s}", "name"), (" moved to ", None), (house, "address"), (".\n", None)]
        text, items = "", []
        for t, k in parts:
            if k:
                items.append((k, len(text)))
            text += t
        out.append((f"t{i}", text, items))
    return out


def test_redaction(spark):
    data = personal(1, 150)
    rows = [(0, i, t) for i, t, _ in data] + [(0, "nul", None), (0, "empty", ""), (1, "long", "The lien survives. " * 5000 + "Yesterday Priya Bakisezi left.")]
    df = spark.createDataFrame(rows, "kind int, id string, text string")
    model = P.fit(df)
    held_out = spark.createDataFrame([(0, i, t) for i, t, _ in personal(9, 60)], df.schema)
    got = {(r["id"], r["what"], r["start_pos"]) for r in P.find_personal(held_out, model).collect()}
    want = {(i, k, p) for i, _, items in personal(9, 60) for k, p in items}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    out = {r["id"]: r for r in P.redact(df, model).collect()}
    assert out["nul"]["text"] is None and out["empty"]["text"] == "" and out["long"]["text"].endswith("Yesterday [NAME] left.")
    i, t, _ = data[0]
    assert "[EMAIL]" in out[i]["text"] and "Marchbane Textiles Ltd." in out[i]["text"] and "Harwick v. Thornebury" in out[i]["text"] and "@" not in out[i]["text"]
    none = spark.createDataFrame([], df.schema)
    assert P.find_personal(none).count() == 0 and P.redact(none).count() == 0


def test_boosted_trees_on_held_out_rows():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.Boosted(rounds=60).fit(x[:3000], y[:3000])
    assert ((m.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
