"""Queries of the problems on training data, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm import contamination as C
from vinculum.llm import mixing as M
from vinculum.llm import names as W
from vinculum.llm import near_duplicates as N
from vinculum.llm import neighbours as V
from vinculum.llm import redaction as P
from vinculum.llm import splitting as S
from vinculum.session import table

KINDS = ("graph_chunks", "document_registry")


def current_documents(spark: SparkSession, d: str, schema: str) -> DataFrame:
    """(id, text) of the registry's current rows of one schema; ties of updated_at go to the later created."""
    rows = table(spark, d, "document_registry").where(F.lower(F.btrim("source_schema")) == schema)
    last = rows.groupBy("document_id").agg(F.max(F.struct("updated_at", "created_at", "content_md")).alias("s"))
    return last.select(F.col("document_id").alias("id"), F.col("s.content_md").alias("text"))


def record_texts(spark: SparkSession, d: str, schema: str) -> DataFrame:
    """(kind, id, text): kind 0 the chunks, kind 1 the registry's documents of one schema."""
    chunks = table(spark, d, "graph_chunks").select(F.lit(0).alias("kind"), F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    return chunks.unionByName(current_documents(spark, d, schema).withColumn("kind", F.lit(1)))


def kind_name(c: str = "kind"):
    return F.when(F.col(c) == 0, KINDS[0]).otherwise(KINDS[1]).alias("rec_table")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = N.near_duplicate_pairs(record_texts(spark, d, "law"), shingle=3, threshold=0.6, min_words=40)
    return pairs.select(kind_name(), F.col("id_a").alias("rec_id_a"), F.col("id_b").alias("rec_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups at five words and a similarity of .8."""
    return N.near_duplicate_groups(record_texts(spark, d, "law")).select(kind_name(), F.col("id").alias("rec_id"), "group_id", "n_copies", "n_links")


def linked_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "raw_entities").select(F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), F.col("entity_text").alias("name"), F.col("canonical_name").alias("canonical"))
    return W.link_names(names)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return W.linked_pairs(linked_names(spark, d)).select(F.col("id_a").alias("entity_id_a"), F.col("id_b").alias("entity_id_b"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its entity."""
    return linked_names(spark, d).select(F.col("id").alias("entity_id"), "entity", "form")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = P.find_personal(record_texts(spark, d, "client"))
    return found.select(kind_name(), F.col("id").alias("rec_id"), F.col("what").alias("kind"), "start_pos").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return P.redact(record_texts(spark, d, "client")).select(kind_name(), F.col("id").alias("rec_id"), "text", "n_items").distinct()


def embedding_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_embeddings").select(F.col("embedding_id").alias("id"), F.col("source_type").alias("kind"), "vector")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = V.similar_pairs(embedding_vectors(spark, d), 0.85)
    return pairs.select(F.col("id_a").alias("embedding_id_a"), F.col("id_b").alias("embedding_id_b"))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id (its hexadecimal digits) is divisible by 100, against all vectors."""
    asked = F.coalesce(F.conv(F.regexp_extract("id", "([0-9a-f]{1,15})$", 1), 16, 10).cast("long") % 100 == 0, F.lit(False))
    near = V.nearest(embedding_vectors(spark, d), 5, queries=asked)
    return near.select(F.col("id").alias("embedding_id"), F.col("other_id").alias("neighbour_id"), F.round("similarity", 5).alias("similarity"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return C.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Documents that held test passages, with the passages cut out."""
    return C.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("n_spans > 0")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "corpus_plan"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.shares(table(spark, d, "documents"), table(spark, d, "corpus_plan"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.split_oversized(table(spark, d, "documents"), table(spark, d, "corpus_plan"))


_P2 = r"""
rows AS (SELECT DISTINCT 'graph_chunks' AS rec_table, chunk_id AS id, content AS text FROM graph_chunks
  UNION ALL SELECT 'document_registry', document_id, arg_max(struct_pack(t := content_md), updated_at).t FROM document_registry WHERE lower(trim(source_schema)) = 'law' GROUP BY document_id),
w AS (SELECT rec_table, id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM rows WHERE text IS NOT NULL),
enough AS (SELECT * FROM w WHERE len(w) >= 40),
sh AS (SELECT DISTINCT rec_table, id, hash(w[i], w[i+1], w[i+2]) AS s FROM (SELECT rec_table, id, w, unnest(range(1, len(w) - 1)) AS i FROM enough)),
n AS (SELECT rec_table, id, count(*) AS n FROM sh GROUP BY ALL),
met AS (SELECT a.rec_table, a.id AS ia, b.id AS ib, count(*) AS c FROM sh a JOIN sh b ON a.rec_table = b.rec_table AND a.s = b.s AND a.id < b.id GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_entities, p4_found, p4_redacted, p6_found, p6_neighbours, p7_found, p7_cleaned, p8_mix, p8_shares, p9_pieces)}

_P6 = r"""
v AS (SELECT DISTINCT embedding_id AS id, lower(trim(source_type, e' \t\r\n')) AS k, CAST(vector AS DOUBLE[]) AS x FROM graph_embeddings
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0 AND source_type IS NOT NULL),
s AS (SELECT a.id AS ia, b.id AS ib, list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.k = b.k AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY ia ORDER BY s DESC, ib) AS r FROM s)"""

_P7 = r"""
d AS (SELECT DISTINCT doc_id, lower(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+'), ' ')) AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, lower(array_to_string(regexp_extract_all(item_text, '[\p{L}\p{N}]+'), ' ')) AS t FROM eval_items),
dw AS (SELECT doc_id, string_split(t, ' ') AS w FROM d), iw AS (SELECT item_id, string_split(t, ' ') AS w FROM i),
dg AS (SELECT doc_id, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM dw)),
ig AS (SELECT item_id, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM iw))"""

ORACLE = {
    "p6_found": f"WITH {_P6} SELECT DISTINCT least(ia, ib) AS embedding_id_a, greatest(ia, ib) AS embedding_id_b FROM r WHERE r <= 5 AND s >= 0.85",
    "p7_found": f"WITH {_P7} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p2_found": f"WITH {_P2} SELECT rec_table, ia AS rec_id_a, ib AS rec_id_b FROM met JOIN n x ON x.rec_table = met.rec_table AND x.id = ia JOIN n y ON y.rec_table = met.rec_table AND y.id = ib WHERE c >= 0.6 * (x.n + y.n - c)".replace("SELECT rec_table, ia", "SELECT met.rec_table, ia"),
}
