"""Mixing sources to target weights by systematic sampling.

Each document of a source is due `rate` copies: the source's share of the total over the tokens it has, at most its cap.
Within a source the due copies are summed up in the order of the documents' sizes, one random offset per source is
added, and a document comes out once for every integer that the sum crosses at it. A document so comes out floor(rate)
or ceil(rate) times, and since neighbours are of like size the tokens drawn stay close to the target.

The order is a range partitioning by (source, tokens, id), so a source of any size is spread over many tasks, and only
one sum per task and source is carried over.

A source that cannot reach its share comes out in full, `max_repeats` times; an absent one not at all. Documents of
sources that the plan does not name, and null sources, take no part. Documents without tokens are due copies like others.
Repeated rows of docs are separate records. Of a plan that names a source twice the greater share counts.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculum.llm.tokens import TOKENIZER, count_tokens
from vinculum.session import materialise, shuffle_width

#: A plan is read to the driver; it may name so many sources at most.
MAX_SOURCES = 10_000


def plan_rates(plan: DataFrame, totals: DataFrame, total_tokens: float | None) -> list[dict]:
    """Per planned source: target_share, max_repeats, have (tokens), n_docs, want (tokens), rate (due copies of a document)."""
    rows = plan.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("p")).join(totals, "source", "left").where("source is not null")
    got = rows.select("source", "p.target_share", "p.max_repeats", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("n_docs", F.lit(0)).alias("n_docs")).limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"mixing: a plan names at most {MAX_SOURCES} sources")
    total = float(sum(r["have"] for r in got)) if total_tokens is None else float(total_tokens)
    out = []
    for r in sorted(got, key=lambda r: r["source"]):
        want = (r["target_share"] or 0.0) * total
        cap = r["max_repeats"] if r["max_repeats"] is not None else 1
        out.append(r.asDict() | {"want": want, "rate": min(float(cap), want / r["have"]) if r["have"] else 0.0})
    return out


def draw(docs: DataFrame, plan: DataFrame, total_tokens: float | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[dict]]:
    """docs (doc_id, source, text) to (doc_id, source, k1, k2, tokens, copies), copies from 0 on, and the rates of plan_rates().

    total_tokens: the size to draw; the tokens of all planned sources if not given.
    """
    named = plan.select("source").where("source is not null").distinct().limit(MAX_SOURCES)
    ours = docs.select("doc_id", "source", "text").join(F.broadcast(named), "source", "left_semi")
    sized = materialise(ours.select("doc_id", "source", *_key(), count_tokens("text", tokenizer).alias("tokens")))
    rates = plan_rates(plan, sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n_docs")), total_tokens)
    spark = docs.sparkSession
    rate = spark.createDataFrame([(r["source"], r["rate"], random.Random(f"{seed}/{r['source']}").random()) for r in rates], "source string, rate double, offset double")
    # the range boundaries are sampled, so the blocks are written down before they are used twice
    blocks = materialise(sized.repartitionByRange(shuffle_width(spark), "source", "tokens", "doc_id").withColumn("block", F.spark_partition_id()))
    w = Window.partitionBy("source", "block").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("source", "block").agg(F.count("*").alias("n")).select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # a block is a range of (source, tokens, doc_id), so there are at most as many sums as tasks and sources together
    ranked = blocks.withColumn("k", F.row_number().over(w)).join(F.broadcast(sums), ["source", "block"]).join(F.broadcast(rate), "source")
    due = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    rank = F.col("start") + F.col("k")
    return ranked.select("doc_id", "source", "k1", "k2", "tokens", (due(rank) - due(rank - 1)).cast("int").alias("copies")), rates


def _key() -> list[Column]:
    """96 bits of the id and the text, nulls included; with the source they tell rows apart."""
    return [F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")]


def mix(docs: DataFrame, plan: DataFrame, **how) -> DataFrame:
    """The mixed corpus: (doc_id, source, copy_no, tokens, text), one row per copy.

    Rows alike in all three columns are one to the join, which brings the copies of all of them, numbered on. The texts are
    shuffled once: what makes them one row is the join's key too.
    """
    drawn, _ = draw(docs, plan, **how)
    key = ["source", "k1", "k2"]
    some = drawn.where("copies > 0").groupBy(*key).agg(F.max("tokens").alias("tokens"), F.sum("copies").cast("int").alias("copies"))
    rows = docs.where("source is not null").select("doc_id", "source", *_key(), "text").dropDuplicates(key)
    return rows.join(some, key).select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "tokens", "text")


def shares(docs: DataFrame, plan: DataFrame, **how) -> DataFrame:
    """Per planned source what it was to give and what it gives: shares of the tokens that really come out."""
    drawn, rates = draw(docs, plan, **how)
    got = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens_out"), F.sum("copies").alias("copies_out"), F.max("copies").alias("most_copies"))
    asked = docs.sparkSession.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], int(r["have"]), r["want"]) for r in rates], "source string, target_share double, max_repeats int, tokens_in long, tokens_wanted double")
    rows = asked.join(got, "source", "left").na.fill(0, ["tokens_out", "copies_out", "most_copies"])
    # one row per planned source, so one task for the total does
    total = F.sum("tokens_out").over(Window.partitionBy())
    return rows.withColumn("actual_share", F.when(total > 0, F.col("tokens_out") / total).otherwise(0.0)).withColumn("reached", F.col("tokens_out") >= 0.98 * F.col("tokens_wanted"))
