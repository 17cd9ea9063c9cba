"""The graph from its parts: entities, relations and chunks in; nodes, edges, communities and quality out. And upserts.

Everything is a composition of the operators beside it; nothing but one-row figures reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions.columns import entity_id
from vinculum.operators import graph as G
from vinculum.operators import relations as R
from vinculum.operators import resolution as ER
from vinculum.session import materialise


@dataclass
class Graph:
    """nodes (node_id, title, entity_type, confidence, document_ids), edges (a, b, weight), relations (source_id,
    target_id, relationship_type, confidence), communities (node_id, community), profile (one row a community) and
    quality (one row)."""

    nodes: DataFrame
    edges: DataFrame
    relations: DataFrame
    communities: DataFrame
    profile: DataFrame
    quality: DataFrame


def discovered(mentions: DataFrame, citations: DataFrame | None, chunk_mentions: DataFrame | None, chunks: DataFrame | None, existing: DataFrame | None = None) -> DataFrame:
    """All ways of finding relations, in order, to (source_id, target_id, relationship_type, confidence, stage).

    mentions (document_id, entity_id), citations (document_id, entity_id, ord), chunk_mentions (chunk_id, entity_id,
    entity_text, entity_type, ord), chunks (chunk_id, content), existing (source_id, target_id, relationship_type): what
    is known and not found again. Without citations or chunks their stages are left out. Of one relation that several
    stages find, the greatest confidence stays, of equal ones the first stage. Confidences are at most 1.
    """
    cols = ["source_id", "target_id", "relationship_type", F.least("confidence", F.lit(1.0)).alias("confidence")]
    stages = {1: R.cross_document(mentions)}
    if citations is not None:
        stages[0] = R.cited_together(citations, mentions)
    if chunk_mentions is not None and chunks is not None:
        stages |= {2: R.inferred(chunk_mentions, chunks), 3: R.cooccurrence(chunk_mentions.select("chunk_id", "entity_id"))}
    out = None
    for i, s in stages.items():
        s = s.select(*cols, F.lit(i).alias("stage"))
        out = s if out is None else out.unionByName(s)
    best = out.groupBy("source_id", "target_id", "relationship_type").agg(F.max_by(F.struct("confidence", "stage"), F.struct(F.col("confidence"), -F.col("stage"))).alias("m"))
    if existing is not None:
        best = best.join(R.relation_index(existing), ["source_id", "target_id", "relationship_type"], "left_anti")
    return best.select("source_id", "target_id", "relationship_type", "m.confidence", "m.stage")


def build(entities: DataFrame, relations: DataFrame, resolution: float = 1.0) -> Graph:
    """entities (entity_id, entity_text, entity_type, confidence, document_ids, ord), relations (source_id, target_id,
    relationship_type, confidence) to a graph.

    Entities are resolved first and the relations' ends led to what they were merged into. Relations that lose an end, or
    both of whose ends are one now, go; of parallel ones the greatest weight stays. Quality: completeness is the share of
    a tenth of all possible edges, at most 1; of one node it is 1, of none 0.
    """
    cluster = materialise(ER.clusters(entities))
    merged = materialise(ER.merge(entities, cluster))
    nodes = materialise(merged.select(F.col("canonical_id").alias("node_id"), F.col("canonical_text").alias("title"), "entity_type", "confidence", "document_ids", "n_merged"))
    ends = materialise(cluster.join(merged.select("cluster_id", "canonical_id"), "cluster_id").select("entity_id", "canonical_id"))
    end = lambda p: ends.select(F.col("entity_id").alias(f"{p}_id"), F.col("canonical_id").alias(f"{p}_node"))
    led = relations.join(end("source"), "source_id").join(end("target"), "target_id").where("source_node <> target_node")
    led = materialise(led.groupBy(F.col("source_node").alias("source_id"), F.col("target_node").alias("target_id"), "relationship_type").agg(F.max("confidence").alias("confidence")))
    weight = G.boosted_weight(F.col("relationship_type"), F.coalesce("confidence", F.lit(0.7)))
    edges = materialise(G.simple_graph(led.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), weight.alias("weight"), weight.alias("ord"))))
    parts = materialise(G.communities(edges, resolution))
    return Graph(nodes, edges, led, parts, profile(nodes, edges, parts), quality(nodes, edges, parts))


def profile(nodes: DataFrame, edges: DataFrame, parts: DataFrame, top: int = 3) -> DataFrame:
    """Per community: n_nodes, n_edges, coherence, the dominant type (of equal ones the first) and its share, and the `top`
    nodes of the greatest degree inside it (of equal ones the first id)."""
    inside = edges.join(parts.select(F.col("node_id").alias("a"), "community"), "a").join(parts.select(F.col("node_id").alias("b"), "community"), ["b", "community"])
    degree = inside.select("community", F.explode(F.array("a", "b")).alias("node_id")).groupBy("community", "node_id").agg(F.count("*").alias("degree"))
    ranked = parts.join(degree, ["community", "node_id"], "left").select("community", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    # only the `top` first of a community leave the aggregate's sort
    by = F.row_number().over(G.Window.partitionBy("community").orderBy(F.desc("degree"), "node_id"))
    central = ranked.withColumn("r", by).where(F.col("r") <= top).groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "node_id"))), lambda x: x["node_id"]).alias("central"))
    kinds = parts.join(nodes.select("node_id", "entity_type"), "node_id").groupBy("community", "entity_type").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("community").agg(F.min_by("entity_type", F.struct(-F.col("n"), "entity_type")).alias("dominant_type"), (F.max("n") / F.sum("n")).alias("dominant_share"))
    return G.coherence(edges, parts).join(kinds, "community", "left").join(central, "community", "left")


def quality(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_communities, completeness, mean_confidence, coverage (nodes in communities of two and more)."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.avg("confidence").alias("mean_confidence"))
    e = edges.agg(F.count("*").alias("n_edges"))
    size = parts.groupBy("community").agg(F.count("*").alias("s"))
    c = size.agg(F.count(F.when(F.col("s") > 1, 1)).alias("n_communities"), F.coalesce(F.sum(F.when(F.col("s") > 1, F.col("s"))), F.lit(0)).alias("in_communities"))
    k = F.col("n_nodes")
    full = F.when(k == 0, 0.0).when(k == 1, 1.0).otherwise(F.least(F.col("n_edges") / (0.1 * k * (k - 1) / 2), F.lit(1.0)))
    one = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c))  # one row each
    return one.select("n_nodes", "n_edges", "n_communities", full.alias("completeness"), "mean_confidence", F.when(k > 0, F.col("in_communities") / k).otherwise(0.0).alias("coverage"))


def upsert_entities(new: DataFrame, old: DataFrame, threshold: float = 0.85) -> DataFrame:
    """new and old (entity_text, entity_type, confidence, document_ids, attributes map) to the table after the upsert:
    (entity_id, entity_text, entity_type, confidence, document_ids, attributes, merge_count, action).

    The id is made of type and text. A known id is updated: documents united, attributes laid over, confidence as it was.
    Else the known record of the same type that is most like it, of a similarity of `threshold` and more, takes it in:
    merged, with the greater confidence and merge_count raised by the new rows. Else it is created. Untouched records have
    the action ``kept``. Of new rows of one id the first by document_ids counts for the text, all for documents and
    attributes. Rows without text or type are left out. Similarity is the mean of the Indel and the token set ratio, over
    all pairs of new and known records of one type.
    """
    attrs = "map<string,string>"
    side = lambda df: df.where("entity_text is not null and entity_type is not null").select(
        entity_id(F.col("entity_text"), F.col("entity_type")).alias("entity_id"), "entity_text", F.upper(F.trim("entity_type")).alias("entity_type"), "confidence",
        F.coalesce("document_ids", F.array().cast("array<string>")).alias("document_ids"), F.coalesce(F.col("attributes").cast(attrs), F.create_map().cast(attrs)).alias("attributes"),
    )
    one = lambda df: df.groupBy("entity_id").agg(
        F.min_by("entity_text", F.struct("document_ids", "entity_text")).alias("entity_text"), F.first("entity_type").alias("entity_type"), F.max("confidence").alias("confidence"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("document_ids")))).alias("document_ids"), _overlay(F.col("attributes"), F.col("document_ids")).alias("attributes"), F.count("*").alias("n"),
    )
    fresh, known = materialise(one(side(new))), materialise(one(side(old)))
    near = ER.near_matches(fresh.join(known.select("entity_id"), "entity_id", "left_anti"), known, threshold)
    acts = ER.upsert_actions(fresh, known, near)
    put = materialise(fresh.join(acts.withColumnRenamed("entity_id", "own_id"), F.col("entity_id") == F.col("own_id")).drop("own_id"))
    gain = put.where("action <> 'created'").groupBy("target_id").agg(
        F.array_distinct(F.flatten(F.collect_set("document_ids"))).alias("more"), _overlay(F.col("attributes"), F.col("entity_id")).alias("over"),
        F.max(F.when(F.col("action") == "merged", F.col("confidence"))).alias("top"), F.count(F.when(F.col("action") == "merged", 1)).alias("n_merged"),
    )
    j = known.join(gain.withColumnRenamed("target_id", "entity_id"), "entity_id", "left")
    action = F.when(F.col("n_merged") > 0, "merged").when(F.col("more").isNotNull(), "updated").otherwise("kept")
    after = j.select(
        "entity_id", "entity_text", "entity_type", F.greatest("confidence", "top").alias("confidence"), F.sort_array(F.array_union("document_ids", F.coalesce("more", F.array().cast("array<string>")))).alias("document_ids"),
        _laid_over(F.col("attributes"), F.coalesce("over", F.create_map().cast(attrs))).alias("attributes"), F.coalesce("n_merged", F.lit(0)).alias("merge_count"), action.alias("action"),
    )
    return after.unionByName(put.where("action = 'created'").select("entity_id", "entity_text", "entity_type", "confidence", "document_ids", "attributes", F.lit(0).cast("long").alias("merge_count"), "action"))


def _laid_over(below: Column, above: Column) -> Column:
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def _overlay(maps: Column, order: Column) -> Column:
    """An aggregate: the maps laid over one another in order."""
    rows = F.sort_array(F.collect_set(F.struct(order.alias("o"), F.sort_array(F.map_entries(maps)).alias("m"))))
    return F.aggregate(rows, F.create_map().cast("map<string,string>"), lambda acc, x: _laid_over(acc, F.map_from_entries(x["m"])))
