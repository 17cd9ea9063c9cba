"""The resolution queries take entities of every type."""

from vinculum.plans.graphs import QUERIES


def test_every_type_is_resolved(spark, tmp_path):
    kinds = ["organization", "person", "court", "statute", "date"]
    rows = [(f"e{k}{i}", t, f"Same {t} text", None, 1.0, f"d{i}", "law", None) for k, t in enumerate(kinds) for i in range(2)]
    cols = "entity_id entity_type entity_text canonical_name confidence_score document_id source_schema case_id".split()
    schema = "entity_id string, entity_type string, entity_text string, canonical_name string, confidence_score double, document_id string, source_schema string, case_id string"
    spark.createDataFrame([dict(zip(cols, x)) for x in rows], schema).write.parquet(str(tmp_path / "raw_entities.parquet"))
    got = {tuple(sorted((r["id_a"], r["id_b"]))) for r in QUERIES["similar_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(f"e{k}0", f"e{k}1") for k in range(len(kinds))}
