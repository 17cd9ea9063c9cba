"""The citation queries take all citations, whatever their ids."""

from vinculum.plans.graphs import QUERIES


def test_chains_of_all_ids(spark, tmp_path):
    rows = [("1", "doc_0a", "doc_9b"), ("2", "doc_9b", "doc_fc"), ("3", "doc_fc", "doc_0d")]
    spark.createDataFrame([(*x, "t", 1) for x in rows], "id string, citing_document_id string, cited_document_id string, citation_text string, page_number int").write.parquet(str(tmp_path / "law_citations.parquet"))
    got = {tuple(r) for r in QUERIES["precedent_chain"](spark, str(tmp_path)).collect()}
    assert got == {("doc_0a", "doc_9b", "doc_fc"), ("doc_9b", "doc_fc", "doc_0d")}
