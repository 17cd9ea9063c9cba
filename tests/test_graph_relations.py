import itertools
import random

import pytest
from pyspark.sql import functions as F

from vinculum.operators import chunks as CH
from vinculum.operators import graph as G
from vinculum.operators import relations as R
from vinculum.operators import resolution as ER
from vinculum.operators import search as S
from vinculum.streaming import updates as U


def complex_graph():
    kinds = ["COURT", "PARTY", "ATTORNEY", "JUDGE"]
    return [(f"ent_{i:03d}", f"Entity {i}", kinds[i % 4], 0.80 + (i % 20) / 100, ["d"], i) for i in range(20)]


SCHEMA = "entity_id string, entity_text string, entity_type string, confidence double, document_ids array<string>, ord int"


def test_golden_deduplication(spark):
    e = spark.createDataFrame(complex_graph(), SCHEMA)
    c = ER.clusters(e)
    m = ER.merge(e, c)
    got = {r["canonical_id"]: (r["canonical_text"], r["n_merged"], r["confidence"]) for r in m.where("n_merged > 1").collect()}
    assert m.count() == 16
    assert got == {"ent_017": ("Entity 1", 3, pytest.approx(0.9033333)), "ent_018": ("Entity 10", 2, pytest.approx(0.94)), "ent_019": ("Entity 15", 2, pytest.approx(0.97))}
    assert {tuple(r) for r in ER.mappings(c, m).collect()} == {("ent_001", "ent_017"), ("ent_013", "ent_017"), ("ent_010", "ent_018"), ("ent_015", "ent_019")}


def test_bound_keeps_all_pairs():
    import numpy as np

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 14))) for _ in range(40)] + ["acme corp", "acme  corp", "corp acme"]
    conf = np.ones(len(texts))
    full, cut = ER.similarity(texts, conf, "PARTY"), ER.similarity(texts, conf, "PARTY", 0.85)
    assert ((full >= 0.85) == (cut >= 0.85)).all() and np.allclose(full[full >= 0.85], cut[full >= 0.85])


def test_low_confidence_never_merges(spark):
    e = spark.createDataFrame([("a", "Same", "PARTY", 0.8, ["d"], 0), ("b", "Same", "PARTY", 0.8, ["d"], 1)], SCHEMA)
    assert ER.similar_pairs(e).count() == 0


def path_graph(spark):
    pairs = [(2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (11, 12)]
    return spark.createDataFrame([(f"e{a:02d}", f"e{b:02d}", 1.0) for a, b in pairs], "a string, b string, weight double")


def test_paths_ranks_and_bridges(spark):
    g = path_graph(spark)
    p = {r["node_id"]: r for r in G.path_measures(g, 16).collect()}
    assert p["e05"]["betweenness"] == pytest.approx(0.1142857) and p["e11"]["betweenness"] == 0.0
    nodes = spark.createDataFrame([(f"e{i:02d}",) for i in range(16)], "node_id string")
    rank = {r["node_id"]: r["rank"] for r in G.pagerank(g, nodes, 60).collect()}
    assert sum(rank.values()) == pytest.approx(1.0) and rank["e11"] == pytest.approx(0.09174, abs=1e-4)
    assert len(G.bridges(g)[0]) == 8 and G.bridges(g)[1] == [f"e{i:02d}" for i in range(3, 9)]
    assert G.connectivity(g) == 0 and G.connectivity(g.where("a <> 'e11'")) == 1


def test_triangles_and_partition(spark):
    two = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    g = spark.createDataFrame([(*e, 1.0) for e in two], "a string, b string, weight double")
    assert {r["node_id"]: r["triangles"] for r in G.triangles(g).collect()} == dict.fromkeys("abcxyz", 1)
    assert G.transitivity(g).first()[0] == pytest.approx(6 / 10)
    c = G.communities(g)
    own = {r["node_id"]: r["community"] for r in c.collect()}
    assert own["a"] == own["b"] == own["c"] != own["x"] == own["y"] == own["z"]
    assert G.modularity(g, c).first()[0] == pytest.approx(2 * (3 / 7 - 0.25))
    assert {r["node_id"]: r["hop"] for r in G.k_hop(g, spark.createDataFrame([("a",)], "node_id string"), 2).collect()} == {"a": 0, "b": 1, "c": 1, "x": 2}
    assert {tuple(r) for r in G.simple_graph(spark.createDataFrame([("b", "a", 0.1, 1), ("a", "b", 0.9, 2), ("a", "a", 1.0, 3), (None, "a", 1.0, 4)], "source string, target string, weight double, ord int")).collect()} == {("a", "b", 0.9)}


def test_mention_join_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab .") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "", "The Supreme Court of A.B. sat", "XSupreme CourtX"]
    names = ["a", "ab", "ab a", "a b a", "b. a", "Supreme Court", "court of a", "", None, "aab", "...", "supreme court of a.b. s"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "text_id int, text string")
    n = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "name_id int, name string")
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(names) if x and y and y.lower() in x.lower()}
    assert {tuple(r) for r in R.mention_join(t, n).collect()} == want


def test_similar_topics_in_blocks(spark):
    rng = random.Random(1)
    v = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(90, [0.0] * 4), (91, None), (92, [1.0])]
    d = spark.createDataFrame(v, "chunk_id int, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(v[:40], 2) if cos(x, y) >= 0.8}
    assert {(r[0], r[1]) for r in R.similar_topics(d, 0.8, block_rows=7).collect()} == want


def test_relations(spark):
    m = spark.createDataFrame([("d1", "a", "PARTY"), ("d1", "b", "COURT"), ("d2", "a", "PARTY"), ("d2", "b", "COURT"), ("d3", "c", "CASE"), (None, "c", "CASE")], "document_id string, entity_id string, entity_type string")
    assert [tuple(r)[:2] for r in R.cross_document(m).collect()] == [("a", "b")] and R.cross_document(m).first()["confidence"] == pytest.approx(1.2)
    assert [tuple(r) for r in R.document_links(m).collect()] == [("d1", "d2", "SHARED_PARTY", 2, 1.0)]
    c = spark.createDataFrame([("c1", "Smith represents Jones.")], "chunk_id string, content string")
    e = spark.createDataFrame([("c1", "s", "Smith", "X", 0), ("c1", "j", "Jones", "Y", 1)], "chunk_id string, entity_id string, entity_text string, entity_type string, ord int")
    assert R.inferred(e, c).first()["relationship_type"] == "REPRESENTS"


def test_search_chunks_updates(spark):
    items = spark.createDataFrame([("a", "the lien and the strike", [1.0, 0.0]), ("b", "a strike", [0.8, 0.6]), ("c", "none", [0.0, 0.0])], "id string, content string, vector array<double>")
    assert [r["id"] for r in S.semantic(items, [1.0, 0.0], 0.5).collect()] == ["a", "b"]
    assert [r["id"] for r in S.bm25(items, "lien strike").orderBy(F.desc("score")).collect()] == ["a", "b"]
    assert S.hybrid(items, [1.0, 0.0], "lien").first()["id"] == "a"
    text = spark.createDataFrame([("x", "a" * 7801), ("y", ""), ("z", None), ("w", "a" * 4000)], "document_id string, text string")
    got = {(r["document_id"], r["start_char"], r["end_char"]) for r in CH.chunk_documents(text).collect()}
    assert got == {("x", 0, 4000), ("x", 3800, 7800), ("x", 7600, 7801), ("w", 0, 4000)}
    old = spark.createDataFrame([("1", "Acme Inc", "PARTY", "d1"), ("2", "Bob", "PARTY", "d2")], "id string, name string, kind string, document_id string")
    new = spark.createDataFrame([("3", "ACME", "party", "d1"), ("4", "Eve", "PARTY", "d1")], old.schema)
    assert sorted(r["id"] for r in U.smart(old, new, "name", "kind").collect()) == ["1", "2", "4"]
    assert sorted(r["id"] for r in U.replace(old, new).collect()) == ["2", "3", "4"]


def test_stream_merges_every_batch(spark, tmp_path):
    src, state = str(tmp_path / "in"), {"v": spark.createDataFrame([("1", "d1")], "id string, document_id string")}
    spark.createDataFrame([("2", "d1"), ("3", "d2")], "id string, document_id string").write.parquet(src)
    out = str(tmp_path / "out")

    def write(df):
        df.write.mode("overwrite").parquet(out)

    q = spark.readStream.schema("id string, document_id string").parquet(src).writeStream.foreachBatch(U.each_batch(lambda: state["v"], write, U.replace)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["2", "3"]


def test_large_groups_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(ER, "BLOCK_TEXTS", 70)
    monkeypatch.setattr(ER, "GROUP_ROWS", 50, raising=False)  # the size above which groups were split by their first word
    rng = random.Random(2)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(200)]
    pairs = [("The Dixwajumtre United Properties Ltd.", "Dixwajumtre United Properties Ltd."), ("Quorhazare Summit Holdings Inc", "Quorhazalre Summit Holdings Inc")]
    texts = [t for p in pairs for t in p] + [f"{a} {b}" for a, b in zip(made, reversed(made))]
    e = spark.createDataFrame([(f"e{i:04d}", t, "ORGANIZATION", 1.0, [f"d{i}"], i) for i, t in enumerate(texts)], "entity_id string, entity_text string, entity_type string, confidence double, document_ids array<string>, ord int")
    got = {(r["id_a"], r["id_b"]) for r in ER.similar_pairs(e).collect()}
    assert {("e0000", "e0001"), ("e0002", "e0003")} <= got
    own = {r["entity_id"]: r["cluster_id"] for r in ER.clusters(e).collect()}
    assert len(own) == len(texts) and own["e0001"] == "e0000" and own["e0003"] == "e0002"


def test_blocks_equal_the_whole_group(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ER, "BLOCK_TEXTS", 7)
    rng = random.Random(3)
    words = ["Harbor", "Harbour", "Summit", "Sumit", "Holdings", "Hldgs", "Inc", "LLC", "The"]
    texts = [" ".join(rng.sample(words, 3)) for _ in range(120)]
    conf = [round(rng.uniform(0.7, 1.0), 2) for _ in texts]
    e = spark.createDataFrame([(f"e{i:03d}", t, "ORGANIZATION", c, [f"d{i}"], i) for i, (t, c) in enumerate(zip(texts, conf))], "entity_id string, entity_text string, entity_type string, confidence double, document_ids array<string>, ord int")
    s = ER.similarity(texts, np.array(conf), "PARTY")
    want = {(f"e{i:03d}", f"e{j:03d}"): s[i, j] for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.85}
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in ER.similar_pairs(e).collect()}
    assert want and set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    owner = ER.greedy(s, 0.85)
    assert {r["entity_id"]: r["cluster_id"] for r in ER.clusters(e).collect()} == {f"e{i:03d}": f"e{o:03d}" for i, o in enumerate(owner)}
