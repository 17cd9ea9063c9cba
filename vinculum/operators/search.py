"""Vector, keyword, hybrid, local and global search over chunks (chunk_id, content, vector, client_id...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculum.functions.columns import cosine


def vector_column(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def semantic(items: DataFrame, query: list[float], floor: float = 0.7, limit: int = 10, client_id: str | None = None) -> DataFrame:
    """items (id, vector[, client_id]) to the `limit` most similar of at least `floor`; vectors of no length never match."""
    d = items.where(F.col("client_id") == client_id) if client_id is not None else items
    s = d.withColumn("similarity", cosine(F.col("vector"), vector_column(query)))
    return s.where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), "id").limit(limit)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bm25(items: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """items (id, content) to (id, score) of those that hold a query word."""
    terms = sorted(set(w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()))
    t = items.select("id", tokens(F.col("content")).alias("w")).select("id", F.size("w").alias("len"), F.filter("w", lambda x: x.isin(terms)).alias("hits"))
    stats = t.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = t.select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    j = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row, and one per query word
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return j.groupBy("id").agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).alias("score"))


def hybrid(items: DataFrame, query: list[float], text: str, alpha: float = 0.5, limit: int = 10, pool: int = 100, k: int = 60) -> DataFrame:
    """Two ranked lists of `pool` joined: alpha times similarity plus the rest times the scaled keyword score, and RRF."""
    v = semantic(items.select("id", "vector"), query, -1.0, pool).select("id", "similarity")
    w = bm25(items, text).orderBy(F.desc("score"), "id").limit(pool)
    # each list has `pool` rows at most, so one task ranks it
    rv = v.withColumn("rv", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))
    rw = w.withColumn("rw", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    span = w.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    j = rv.join(rw, "id", "full").crossJoin(F.broadcast(span))
    key = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.when(F.col("score").isNotNull(), 1.0))
    rrf = F.coalesce(1.0 / (k + F.col("rv")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("rw")), F.lit(0.0))
    out = j.select("id", F.coalesce("similarity", F.lit(0.0)).alias("semantic_score"), F.coalesce(key, F.lit(0.0)).alias("keyword_score"), rrf.alias("rrf_score"))
    return out.withColumn("combined_score", alpha * F.col("semantic_score") + (1 - alpha) * F.col("keyword_score")).orderBy(F.desc("combined_score"), "id").limit(limit)


def local(items: DataFrame, members: DataFrame, query: list[float], floor: float = 0.7, limit: int = 10) -> DataFrame:
    """Only items that are members (id) of the communities asked for."""
    return semantic(items.join(members.select("id").distinct(), "id", "left_semi"), query, floor, limit)


def global_(items: DataFrame, communities: DataFrame, members: DataFrame, query: list[float], top: int = 5, floor: float = 0.6, limit: int = 10) -> DataFrame:
    """communities (community, vector), members (community, id): the best communities' items, each once by its best score."""
    best = semantic(communities.withColumnRenamed("community", "id"), query, floor, top).select(F.col("id").alias("community"), F.col("similarity").alias("community_relevance"))
    m = members.join(F.broadcast(best), "community").groupBy("id").agg(F.max("community_relevance").alias("community_relevance"), F.max_by("community", F.struct("community_relevance", "community")).alias("community"))
    s = items.join(m, "id").withColumn("similarity", cosine(F.col("vector"), vector_column(query)))
    return s.withColumn("relevance_score", F.col("similarity") * F.col("community_relevance")).orderBy(F.desc("relevance_score"), "id").limit(limit)


def quality(results: DataFrame, limit: int = 10) -> DataFrame:
    """One row: .7 of the mean similarity, .2 of how full the list is, .2 at most of the variance; 0 of none."""
    a = results.agg(F.avg("similarity").alias("m"), F.count("*").alias("n"), F.var_pop("similarity").alias("v"))
    return a.select(F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.7 * F.col("m") + 0.2 * F.least(F.col("n") / limit, F.lit(1.0)) + F.least(2 * F.col("v"), F.lit(0.2)))).alias("quality"))


def rag_answer(context: list[str], evidence: list[str], reasoning: list[str]) -> str:
    parts = [("Context", context), ("Evidence", evidence), ("Reasoning", reasoning)]
    return " | ".join(f"{k}: {'; '.join(v)}" for k, v in parts if v)
