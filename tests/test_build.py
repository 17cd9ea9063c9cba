from pyspark.sql import functions as F

from vinculum.operators import build as B

NEW = "entity_text string, entity_type string, confidence double, document_ids array<string>, attributes map<string,string>"


def test_upsert_updates_merges_and_creates(spark):
    old = spark.createDataFrame([("Acme Holdings Ltd", "PARTY", 0.6, ["d1"], {"a": "1", "b": "1"}), ("Harwick Superior Court", "COURT", 0.9, None, None), ("Quiet Co", "PARTY", 0.5, ["d9"], {})], NEW)
    new = spark.createDataFrame(
        [("acme holdings ltd ", "party", 0.99, ["d2"], {"a": "2"}), ("Harwick Superior Courts", "COURT", 0.95, ["d3"], {"c": "3"}), ("Harwick Superior Courts", "COURT", 0.95, ["d3"], {"c": "3"}), ("Other Bank", "PARTY", 0.7, [], None), (None, "PARTY", 0.7, [], None)],
        NEW,
    )
    got = {r["entity_text"]: r for r in B.upsert_entities(new, old).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"Acme Holdings Ltd": "updated", "Harwick Superior Court": "merged", "Quiet Co": "kept", "Other Bank": "created"}
    a, h = got["Acme Holdings Ltd"], got["Harwick Superior Court"]
    assert a["confidence"] == 0.6 and a["document_ids"] == ["d1", "d2"] and a["attributes"] == {"a": "2", "b": "1"}
    assert h["confidence"] == 0.95 and h["document_ids"] == ["d3"] and h["merge_count"] == 1 and h["attributes"] == {"c": "3"}
    assert B.upsert_entities(new.where("1 = 0"), old).groupBy("action").count().collect()[0]["count"] == 3


def test_build_leads_relations_to_merged_nodes(spark):
    rows = [("e1", "Acme Marine Holdings", "ORGANIZATION", 0.9, ["d1"], 1), ("e2", "Acme Marine Holdings", "ORGANIZATION", 0.95, ["d2"], 2), ("e3", "Zeta Court", "COURT", 0.9, ["d1"], 3), ("e4", "Unlinked Thing", "STATUTE", 0.9, ["d1"], 4)]
    entities = spark.createDataFrame(rows, "entity_id string, entity_text string, entity_type string, confidence double, document_ids array<string>, ord long")
    relations = spark.createDataFrame([("e1", "e3", "CITES", 0.6), ("e2", "e3", "CITES", 0.4), ("e1", "e2", "SAME", 0.9), ("e1", "gone", "CITES", 0.9)], "source_id string, target_id string, relationship_type string, confidence double")
    g = B.build(entities, relations)
    assert {tuple(r) for r in g.relations.collect()} == {("e2", "e3", "CITES", 0.6)}
    (edge,) = g.edges.collect()
    assert (edge["a"], edge["b"], round(edge["weight"], 6)) == ("e2", "e3", 0.9)
    q = g.quality.first()
    assert (q["n_nodes"], q["n_edges"], q["completeness"]) == (3, 1, 1.0) and round(q["coverage"], 4) == 0.6667
    (p,) = g.profile.where(F.col("n_nodes") > 1).collect()
    assert p["central"] == ["e2", "e3"] and round(p["coherence"], 6) == 0.9 and p["dominant_share"] == 0.5
