"""Queries of the graph part: resolution, relations, graph measures, vector and keyword search, chunks, updates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vinculum.constants import TYPE_IMPORTANCE
from vinculum.functions import columns as C
from vinculum.functions.similarity import fuzzy_ratio, tfidf_matrix, token_set_ratio
from vinculum.operators import build as B
from vinculum.operators import chunks as CH
from vinculum.operators import components as CC
from vinculum.operators import graph as G
from vinculum.operators import relations as R
from vinculum.operators import resolution as ER
from vinculum.operators import search as S
from vinculum.plans.base import Plans, Relations
from vinculum.session import materialise
from vinculum.streaming import updates as U

P = Plans()
add, same = P.add, P.same
_r = F.round


def resolvable(r: Relations):
    """All entities with their own types, in order of their ids."""
    return r.entities.select("entity_id", "entity_text", "entity_type", "confidence", F.array("document_id").alias("document_ids"), F.xxhash64("entity_id").alias("ord"))


def mentions(r: Relations):
    return r.entities.where("document_id is not null").select("document_id", F.lower(F.trim("entity_text")).alias("entity_id"), "entity_type")


# --- entity resolution with kernels
def _merged(r: Relations):
    e = resolvable(r)
    return ER.merge(e, ER.clusters(e))


add("similar_pairs", lambda r: ER.similar_pairs(resolvable(r)))
add("dedup_clusters", lambda r: ER.clusters(resolvable(r)))
add("dedup_components", lambda r: ER.cluster_components(resolvable(r)))
add("dedup_merge", _merged)
add("canonical_text", lambda r: _merged(r).select("canonical_id", "canonical_text"))
add("canonical_mappings", lambda r: ER.mappings(ER.clusters(resolvable(r)), _merged(r)))
add("dedup_entities", lambda r: _merged(r).drop("cluster_id"))
_pairs = "SELECT a.entity_id AS x, b.entity_id AS y, a.entity_text AS s, b.entity_text AS t FROM entities a JOIN entities b ON a.document_id = b.document_id AND a.entity_type = b.entity_type AND a.entity_id < b.entity_id"
add("fuzzy_ratio", lambda r: r.sql(_pairs).select("x", "y", fuzzy_ratio(F.col("s"), F.col("t")).alias("ratio")))
add("token_set_ratio", lambda r: r.sql(_pairs).select("x", "y", token_set_ratio(F.col("s"), F.col("t")).alias("ratio")))


def _tfidf(b):
    import numpy as np
    import pandas as pd

    b = b.sort_values("entity_id")
    m = tfidf_matrix(b["entity_text"].tolist())
    s = m @ m.T
    i, j = np.nonzero(np.triu(s >= 0.5, 1))
    ids = b["entity_id"].to_numpy()
    return pd.DataFrame({"x": ids[i], "y": ids[j], "cosine": s[i, j]})


add("tfidf_cosine", lambda r: r.entities.where("document_id is not null").groupBy("document_id").applyInPandas(lambda b: _tfidf(b), "x string, y string, cosine double"))
add("combined_similarity", lambda r: ER.similar_pairs(resolvable(r)).select("id_a", "id_b", _r("similarity", 6).alias("similarity")))
_new, _old = "source_schema = 'client'", "source_schema = 'law'"


def _upsert(r: Relations):
    key = C.entity_id(F.col("entity_text"), F.col("entity_type")).alias("entity_id")
    new, old = r.entities.where(_new).select(key, C.canonical_form(F.col("entity_text")).alias("f")), r.entities.where(_old).select(key, C.canonical_form(F.col("entity_text")).alias("f"))
    near = new.join(old.groupBy("f").agg(F.min("entity_id").alias("match_id")), "f").select("entity_id", "match_id", F.lit(1.0).alias("similarity"))
    return ER.upsert_actions(new, old, near)


_form = r"trim(regexp_replace(regexp_replace(trim(lower(entity_text)), '\b(inc|llc|corp|co|ltd)\b\.?', '', 'g'), '\s+', ' ', 'g'))"
_key = "concat('entity_', substr(md5(concat(upper(trim(entity_type)), ':', lower(trim(entity_text)))), 1, 16))"
_up = f"WITH e AS (SELECT {_key} AS k, {_form} AS f, source_schema AS s FROM entities), o AS (SELECT f, min(k) AS m FROM e WHERE s = 'law' GROUP BY f), n AS (SELECT k, max(m) AS m FROM (SELECT DISTINCT k, f FROM e WHERE s = 'client') x LEFT JOIN o USING (f) GROUP BY k), a AS (SELECT k AS entity_id, CASE WHEN k IN (SELECT k FROM e WHERE s = 'law') THEN k ELSE coalesce(m, k) END AS target_id, CASE WHEN k IN (SELECT k FROM e WHERE s = 'law') THEN 'updated' WHEN m IS NOT NULL THEN 'merged' ELSE 'created' END AS action FROM n)"
add("upsert_actions", _upsert, _up + " SELECT * FROM a")
add("batch_upsert_counts", lambda r: _upsert(r).groupBy("action").agg(F.count("*").alias("n")), _up + " SELECT action, count(*) AS n FROM a GROUP BY action")



def _upserted(r: Relations, s: str):
    return r.entities.where(f"source_schema = '{s}'").select("entity_text", "entity_type", "confidence", F.array_compact(F.array("document_id")).alias("document_ids"), F.create_map(F.lit("schema"), F.col("source_schema")).alias("attributes"))


add("entity_upsert", lambda r: B.upsert_entities(_upserted(r, "client"), _upserted(r, "law")).select("entity_id", "entity_type", "confidence", F.size("document_ids").alias("n_documents"), F.col("attributes")["schema"].alias("schema"), "merge_count", "action"))


def _built(r: Relations):
    pairs = R.pairs_within(r.entities.where("document_id is not null"), "document_id", "entity_id")
    relations = pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("CO_OCCURS").alias("relationship_type"), F.lit(0.7).alias("confidence"))
    return B.build(resolvable(r), relations)


add("graph_build", lambda r: _built(r).profile)
add("graph_build_quality", lambda r: _built(r).quality)

# --- relations
add("relation_index", lambda r: r.edges.select("source", "target", "relationship_type").unionByName(r.edges.where("relationship_type like 'A%'").select(F.col("target").alias("source"), F.col("source").alias("target"), "relationship_type")).distinct(), "SELECT source, target, relationship_type FROM edges UNION SELECT target, source, relationship_type FROM edges WHERE relationship_type LIKE 'A%'")
_m = "WITH m AS (SELECT DISTINCT document_id, lower(trim(entity_text)) AS e, entity_type AS t FROM entities WHERE document_id IS NOT NULL)"
add("rel_cross_document", lambda r: R.cross_document(mentions(r)).withColumn("confidence", _r("confidence", 6)), _m + ", d AS (SELECT DISTINCT document_id, e FROM m) SELECT a.e AS source_id, b.e AS target_id, 'CROSS_DOCUMENT_ASSOCIATION' AS relationship_type, count(*) AS n_docs, round(least(0.6 + 0.1 * count(*), 0.95) * 1.5, 6) AS confidence FROM d a JOIN d b ON a.document_id = b.document_id AND a.e < b.e GROUP BY a.e, b.e HAVING count(*) >= 2")
add("rel_cooccurrence", lambda r: R.cooccurring(R.shared_groups(*r.shared(), 2)).withColumn("confidence", _r("confidence", 6)), "SELECT a.node_id AS source_id, b.node_id AS target_id, 'FREQUENTLY_COOCCURS' AS relationship_type, count(*) AS n_chunks, round(least(0.5 + 0.05 * count(*), 0.9), 6) AS confidence FROM members a JOIN members b ON a.community_id = b.community_id AND a.node_id < b.node_id GROUP BY a.node_id, b.node_id HAVING count(*) >= 2")
add("rel_cited_together", lambda r: R.cited_together(r.cites.where("citing is not null and cited is not null").select(F.col("citing").alias("document_id"), F.col("cited").alias("entity_id"), F.coalesce("page_number", F.lit(0)).alias("ord")), r.entities.where("document_id is not null").select("document_id", "entity_id")).withColumn("confidence", _r("confidence", 6)), "WITH p AS (SELECT c.cited AS source_id, e.entity_id AS target_id, min(struct_pack(o := coalesce(c.page_number, 0), d := c.citing)).d AS document_id FROM cites c JOIN entities e ON e.document_id = c.citing WHERE c.cited IS NOT NULL AND c.cited <> e.entity_id GROUP BY 1, 2) SELECT source_id, target_id, 'CITED_TOGETHER' AS relationship_type, document_id, 1.4 AS confidence FROM p")
add("pairs_within_group", lambda r: R.pairs_within(r.members, "community_id", "node_id"), "SELECT x.community_id, x.node_id AS a, y.node_id AS b FROM members x JOIN members y ON x.community_id = y.community_id AND x.node_id < y.node_id")


def _names(r: Relations):
    return r.nodes.where("node_type = 'entity'").select(F.col("title").alias("name_id"), F.col("title").alias("name")).distinct()


def _texts(r: Relations):
    return r.chunks.select(F.col("chunk_id").alias("text_id"), F.col("content").alias("text"))


_mj = "WITH n AS (SELECT DISTINCT title FROM nodes WHERE node_type = 'entity' AND title IS NOT NULL AND title <> ''), mj AS (SELECT chunk_id, title FROM chunks JOIN n ON contains(lower(content), lower(title)))"
add("mention_join", lambda r: R.mention_join(_texts(r), _names(r)).select(F.col("text_id").alias("chunk_id"), F.col("name_id").alias("title")), _mj + " SELECT DISTINCT chunk_id, title FROM mj")


def _chunk_pairs(r: Relations):
    m = R.mention_join(_texts(r), _names(r))
    return m.join(r.chunks.select(F.col("chunk_id").alias("text_id"), "content"), "text_id").select(F.col("text_id").alias("chunk_id"), "content", F.col("name_id").alias("entity_id"), F.col("name_id").alias("entity_text"), F.lit(0.95).alias("confidence"))


add("chunk_entity_connections", lambda r: R.chunk_connections(_chunk_pairs(r)), _mj + ", s AS (SELECT DISTINCT mj.chunk_id, title AS entity_id, lower(content) AS c, lower(title) AS t FROM mj JOIN chunks ON chunks.chunk_id = mj.chunk_id), o AS (SELECT chunk_id, entity_id, c, len(list_filter(range(1, length(c) + 1), lambda i: substr(c, i, length(t)) = t)) AS n, strpos(c, t) - 1 AS p FROM s), q AS (SELECT chunk_id, entity_id, 0.5 * least(n / 10, 1.0) + 0.3 * (1 - p / length(c)) + 0.2 * 0.95 AS v, p FROM o) SELECT chunk_id, entity_id, round(v, 4) AS relevance_score, CAST(p AS INTEGER) AS position_in_chunk FROM q WHERE v >= 0.5")


def _in_chunks(r: Relations):
    m = R.mention_join(_texts(r), _names(r))
    kind = F.get_json_object("metadata", "$.entity_type")
    t = r.nodes.where("node_type = 'entity'").groupBy("title").agg(F.min(kind).alias("entity_type"))
    return m.join(t, F.col("name_id") == F.col("title")).select(F.col("text_id").alias("chunk_id"), F.col("name_id").alias("entity_id"), F.col("name_id").alias("entity_text"), "entity_type", F.col("name_id").alias("ord"))


add("rel_inferred", lambda r: R.inferred(_in_chunks(r), r.chunks.select("chunk_id", "content")))
add("keyword_between", lambda r: R.inferred(_in_chunks(r).withColumn("entity_type", F.lit("OTHER")), r.chunks.select("chunk_id", "content")).groupBy("relationship_type").agg(F.count("*").alias("n")))
add("xref_citation", lambda r: r.cites.alias("x").join(r.chunks.alias("s"), F.col("x.citing") == F.col("s.document_id")).join(r.chunks.alias("t"), F.col("x.cited") == F.col("t.document_id")).where("s.chunk_index = 0 and t.chunk_index = 0 and s.chunk_id <> t.chunk_id").select(F.col("s.chunk_id").alias("source_chunk_id"), F.col("t.chunk_id").alias("target_chunk_id"), F.lit("citation").alias("reference_type")).distinct(), "SELECT DISTINCT s.chunk_id AS source_chunk_id, t.chunk_id AS target_chunk_id, 'citation' AS reference_type FROM cites x JOIN chunks s ON s.document_id = x.citing JOIN chunks t ON t.document_id = x.cited WHERE s.chunk_index = 0 AND t.chunk_index = 0 AND s.chunk_id <> t.chunk_id")


def _vectors(r: Relations):
    return r.sql("SELECT vec_id AS id, embedding AS vector, label FROM embeddings")


def _query(r: Relations) -> list[float]:
    return list(_vectors(r).where("id = (SELECT min(vec_id) FROM embeddings)").first()["vector"])


_cos = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_q = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_sim = f"WITH v AS (SELECT vec_id AS id, label, embedding AS x, {_cos.format(a='embedding', b=_q)} AS s FROM embeddings)"
_self = f"SELECT a.vec_id AS source_chunk_id, b.vec_id AS target_chunk_id, {_cos.format(a='a.embedding', b='b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label"
add("vector_self_join", lambda r: R.similar_topics(_vectors(r).select(F.col("id").alias("chunk_id"), F.col("vector").alias("embedding")), 0.45).select("source_chunk_id", "target_chunk_id", _r("confidence_score", 4).alias("confidence_score")), f"SELECT a.vec_id AS source_chunk_id, b.vec_id AS target_chunk_id, round({_cos.format(a='a.embedding', b='b.embedding')}, 4) AS confidence_score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_cos.format(a='a.embedding', b='b.embedding')} >= 0.45")
add("xref_similar_topic", lambda r: R.similar_topics(_vectors(r).select(F.col("id").alias("chunk_id"), F.col("vector").alias("embedding")), 0.4).groupBy("source_chunk_id").agg(F.count("*").alias("n")), f"SELECT a.vec_id AS source_chunk_id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_cos.format(a='a.embedding', b='b.embedding')} >= 0.4 GROUP BY 1")
add("xref_dedup", lambda r: R.keep_greatest(r.edges.select("source", "target", "relationship_type", "weight", "edge_id").where("weight is not null"), ["source", "target", "relationship_type"], "weight", ["edge_id"]), "SELECT source, target, relationship_type, weight, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relationship_type ORDER BY weight DESC, edge_id) AS r FROM edges WHERE weight IS NOT NULL) WHERE r = 1")
add("enrich_relationships", lambda r: R.enrich(r.edges.select("edge_id", F.col("source").alias("source_id"), F.col("target").alias("target_id"), "confidence"), r.nodes.select(F.col("node_id").alias("entity_id"), F.col("title").alias("entity_text"), F.col("node_type").alias("entity_type"))), "SELECT e.edge_id, e.source AS source_id, e.target AS target_id, e.confidence, s.title AS source_text, s.node_type AS source_type, t.title AS target_text, t.node_type AS target_type FROM edges e JOIN nodes s ON s.node_id = e.source JOIN nodes t ON t.node_id = e.target WHERE e.confidence >= 0.5")
_dl = _m + ", d AS (SELECT document_id, e, min(t) AS t FROM m GROUP BY 1, 2), n AS (SELECT document_id, count(*) AS n FROM d GROUP BY 1) SELECT a.document_id AS source_document_id, b.document_id AS target_document_id, count(*) AS n_shared, round(count(*) / least(min(x.n), min(y.n)), 6) AS strength FROM d a JOIN d b ON a.e = b.e AND a.document_id < b.document_id JOIN n x ON x.document_id = a.document_id JOIN n y ON y.document_id = b.document_id GROUP BY 1, 2"
add("document_links", lambda r: R.document_links(mentions(r)).select("source_document_id", "target_document_id", "n_shared", _r("strength", 6).alias("strength")), _dl)
add("document_link_types", lambda r: R.document_links(mentions(r)).groupBy("link_type").agg(F.count("*").alias("n")))
add("document_links_tenant", lambda r: R.document_links(mentions(r).join(r.docs.select("document_id", "client_id"), "document_id"), "client_id").groupBy("source_document_id").agg(F.count("*").alias("n")), _m + ", d AS (SELECT DISTINCT m.document_id, e, client_id FROM m JOIN docs ON docs.document_id = m.document_id) SELECT source_document_id, count(*) AS n FROM (SELECT DISTINCT a.document_id AS source_document_id, b.document_id FROM d a JOIN d b ON a.e = b.e AND a.client_id IS NOT DISTINCT FROM b.client_id AND a.document_id < b.document_id) GROUP BY 1")


def _discovered(r: Relations):
    """How many new relations of each type the four stages find between the entities, told apart by their trimmed text.

    Citations and chunks may be absent, as their stages' input may be; what the communities share stands for chunks then.
    """
    m = materialise(mentions(r))
    cited = found_in = chunks = None
    if r.has("law_citations"):
        cites = r.cites.select(F.col("citing").alias("document_id"), F.col("citation_text").alias("text"), F.coalesce("page_number", F.lit(0)).alias("ord"))
        cited = R.cited_entities(cites, m.withColumn("entity_text", F.col("entity_id")))
    if r.has("graph_chunks"):
        chunks = materialise(r.chunks.select("chunk_id", "content"))
        # entities of no document are looked for in chunks as well
        kinds = materialise(r.entities.select(F.lower(F.trim("entity_text")).alias("name_id"), "entity_type").distinct())
        texts = chunks.select(F.col("chunk_id").alias("text_id"), F.col("content").alias("text"))
        met = R.mention_join(texts, kinds.select("name_id", F.col("name_id").alias("name")).distinct()).join(kinds, "name_id")
        found_in = materialise(met.select(F.col("text_id").alias("chunk_id"), F.col("name_id").alias("entity_id"), F.col("name_id").alias("entity_text"), "entity_type", F.col("name_id").alias("ord")))
    name = lambda p: r.nodes.select(F.col("node_id").alias(p), F.lower(F.trim("title")).alias(f"{p}_id"))
    known = r.edges.join(name("source"), "source").join(name("target"), "target").select("source_id", "target_id", "relationship_type")
    found = B.discovered(m, cited, found_in, chunks, known).groupBy("relationship_type").agg(F.count("*").alias("n"))
    if chunks is None:
        found = found.unionByName(R.shared_groups_count(*r.shared(), 2).where("n > 0").select(F.lit("FREQUENTLY_COOCCURS").alias("relationship_type"), "n"))
    return found


add("discover_relationships", _discovered)
same("build_node_records", "SELECT entity_id AS node_id, 'entity' AS node_type, entity_text AS title, coalesce(confidence, 0.9) AS confidence FROM entities")
same("build_edge_records", "SELECT concat(source, '->', target) AS edge_key, relationship_type, least(coalesce(weight, 0.7), 1.0) AS weight FROM edges WHERE source IS NOT NULL AND target IS NOT NULL")

# --- graph
def simple(r: Relations):
    e = r.edges.select("source", "target", F.coalesce("weight", F.lit(0.5)).alias("weight"), F.coalesce("weight", F.lit(0.5)).alias("ord"))
    return G.simple_graph(e, r.nodes)


def parts(r: Relations):
    return r.members.groupBy("node_id").agg(F.min("community_id").alias("community"))


add("simple_graph_edges", lambda r: simple(r), "SELECT a, b, weight FROM simple")
add("shared_citation_edges", lambda r: R.pairs_within(r.cites.where("citing is not null and cited is not null"), "cited", "citing").groupBy("a", "b").agg(F.count("*").alias("n"), F.lit(0.6).alias("weight")), "SELECT x.citing AS a, y.citing AS b, count(*) AS n, 0.6 AS weight FROM (SELECT DISTINCT citing, cited FROM cites WHERE cited IS NOT NULL) x JOIN (SELECT DISTINCT citing, cited FROM cites) y ON x.cited = y.cited AND x.citing < y.citing GROUP BY 1, 2")
_hops = "WITH RECURSIVE s AS (SELECT node_id FROM nodes ORDER BY node_id LIMIT 5), w(start, node_id, hop) AS (SELECT node_id, node_id, 0 FROM s UNION SELECT w.start, t.dst, w.hop + 1 FROM w JOIN twoway t ON t.src = w.node_id WHERE w.hop < 2) SELECT start, node_id, min(hop) AS hop FROM w GROUP BY 1, 2"
_first5 = lambda r: r.nodes.orderBy("node_id").limit(5).select("node_id")
add("k_hop", lambda r: G.k_hop(simple(r), _first5(r), 2), _hops)
_pathsql = "WITH RECURSIVE w AS (SELECT node_id AS start, node_id, 0 AS hop, {one} AS path FROM (SELECT node_id FROM nodes ORDER BY node_id LIMIT 3) x UNION ALL SELECT w.start, t.dst, w.hop + 1, {app} FROM w JOIN twoway t ON t.src = w.node_id WHERE w.hop < 2 AND NOT {has}) SELECT start, node_id, hop, {txt} AS path FROM w"
same("k_hop_paths", _pathsql, one="array(node_id) || [node_id]", app="array_append(w.path, t.dst) || list_append(w.path, t.dst)", has="array_contains(w.path, t.dst) || list_contains(w.path, t.dst)", txt="array_join(path, '/') || array_to_string(path, '/')")
add("subgraph", lambda r: G.k_hop(simple(r), _first5(r), 1).select("node_id").distinct(), _hops.replace("w.hop < 2", "w.hop < 1").replace("SELECT start, node_id, min(hop) AS hop FROM w GROUP BY 1, 2", "SELECT DISTINCT node_id FROM w"))
add("connected_components", lambda r: CC.connected_components(simple(r).select("a", "b")).groupBy("component").agg(F.count("*").alias("size")), "WITH RECURSIVE w(id, root) AS (SELECT node_id, node_id FROM degs UNION SELECT t.dst, w.root FROM w JOIN twoway t ON t.src = w.id WHERE t.dst > w.root) SELECT component, count(*) AS size FROM (SELECT id, min(root) AS component FROM w GROUP BY id) GROUP BY component")
add("graph_basic_metrics", lambda r: G.basic_metrics(simple(r), r.nodes).select("nodes", "edges", _r("density", 8).alias("density"), _r("average_degree", 6).alias("average_degree")), "SELECT n AS nodes, e AS edges, round(2.0 * e / (n * (n - 1)), 8) AS density, round(2.0 * e / n, 6) AS average_degree FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM simple) AS e)")
add("degree_centrality", lambda r: G.degrees(simple(r)).select("node_id", "degree"), "SELECT node_id, degree FROM degs")
_tri = "WITH t AS (SELECT x.a AS u, x.b AS v, y.b AS w FROM simple x JOIN simple y ON x.b = y.a JOIN simple z ON z.a = x.a AND z.b = y.b), c AS (SELECT id, count(*) AS t FROM (SELECT unnest([u, v, w]) AS id FROM t) GROUP BY id)"
add("clustering", lambda r: G.clustering(simple(r)).select("node_id", "degree", "triangles", _r("clustering", 6).alias("clustering")), _tri + " SELECT node_id, degree, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN round(2.0 * coalesce(t, 0) / (degree * (degree - 1)), 6) ELSE 0 END AS clustering FROM degs LEFT JOIN c ON c.id = degs.node_id")
add("transitivity", lambda r: G.transitivity(simple(r)).select(_r("transitivity", 8).alias("transitivity")), _tri + " SELECT round((SELECT sum(t) FROM c) / (SELECT sum(degree * (degree - 1) / 2) FROM degs), 8) AS transitivity")
add("degree_assortativity", lambda r: G.assortativity(simple(r)).select(_r("assortativity", 6).alias("assortativity")), "SELECT round(corr(x.degree, y.degree), 6) AS assortativity FROM twoway JOIN degs x ON x.node_id = src JOIN degs y ON y.node_id = dst")
add("modularity", lambda r: G.modularity(simple(r), parts(r)).select(_r("modularity", 6).alias("modularity")), "WITH p AS (SELECT node_id, min(community_id) AS c FROM members GROUP BY 1), m AS (SELECT sum(weight) AS m FROM simple), i AS (SELECT x.c, sum(weight) AS w FROM simple JOIN p x ON x.node_id = a JOIN p y ON y.node_id = b WHERE x.c = y.c GROUP BY 1), d AS (SELECT c, sum(weight) AS d FROM twoway JOIN p ON p.node_id = src GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM d LEFT JOIN i USING (c), m")


def _coherence(r: Relations):
    nodes, comms = r.sides()
    # the communities of a block have the same nodes and edges
    c = G.coherence(simple(r), nodes.select(F.col("block").alias("community"), "node_id")).withColumnRenamed("community", "block")
    return comms.join(c, "block").select(F.col("community_id").alias("community"), "n_nodes", "n_edges", _r("coherence", 6).alias("coherence"))


add("community_coherence", _coherence, "WITH s AS (SELECT community_id, count(*) AS n FROM members GROUP BY 1), i AS (SELECT x.community_id, count(*) AS e, avg(weight) AS w FROM simple JOIN members x ON x.node_id = a JOIN members y ON y.node_id = b AND y.community_id = x.community_id GROUP BY 1) SELECT s.community_id AS community, n AS n_nodes, coalesce(e, 0) AS n_edges, round(CASE WHEN n <= 1 THEN 1.0 ELSE coalesce(2.0 * e / (n * (n - 1)) * w, 0) END, 6) AS coherence FROM s LEFT JOIN i USING (community_id)")
add("subgraph_density", lambda r: G.basic_metrics(G.simple_graph(r.edges.select("source", "target", "weight", F.lit(0).alias("ord")), r.nodes.where("node_type = 'entity'")), r.nodes.where("node_type = 'entity'")).select("nodes", "edges", _r("density", 8).alias("density")), "WITH n AS (SELECT node_id FROM nodes WHERE node_type = 'entity'), e AS (SELECT a FROM simple WHERE a IN (SELECT node_id FROM n) AND b IN (SELECT node_id FROM n)) SELECT x AS nodes, y AS edges, round(2.0 * y / (x * (x - 1)), 8) AS density FROM (SELECT (SELECT count(*) FROM n) AS x, (SELECT count(*) FROM e) AS y)")
_pr = "t AS (SELECT src, sum(weight) AS w FROM twoway GROUP BY 1), n AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT node_id, 1.0::DOUBLE / n AS x FROM nodes, n)"
_prs = ", ".join(f"g{i} AS (SELECT dst, sum(x * weight / w) AS g FROM r{i} JOIN twoway ON src = node_id JOIN t USING (src) GROUP BY 1), l{i} AS (SELECT coalesce(sum(x), 0) AS l FROM r{i} WHERE node_id NOT IN (SELECT src FROM t)), r{i + 1} AS (SELECT r{i}.node_id, 0.15 / n + 0.85 * (coalesce(g, 0) + l / n) AS x FROM r{i} LEFT JOIN g{i} ON dst = r{i}.node_id, l{i}, n)" for i in range(5))
add("pagerank", lambda r: G.pagerank(simple(r), r.nodes, 5).select("node_id", _r(F.col("rank") * 1000, 5).alias("rank")), f"WITH {_pr}, {_prs} SELECT node_id, round(x * 1000, 5) AS rank FROM r5")
add("eigenvector_centrality", lambda r: G.eigenvector(simple(r), 10))
add("betweenness", lambda r: G.path_measures(simple(r), r.nodes.count()).select("node_id", "betweenness"))
add("closeness", lambda r: G.path_measures(simple(r), r.nodes.count()).select("node_id", "closeness"))
add("diameter_radius", lambda r: G.extents(simple(r)))
add("bridges", lambda r: G.cut_edges_and_nodes(simple(r)))
add("connectivity", lambda r: r.spark.createDataFrame([(G.connectivity(simple(r)),)], "edge_connectivity int"))
add("communities_detect", lambda r: G.communities(simple(r)))
add("communities_filter", lambda r: G.filter_communities(simple(r), G.communities(simple(r))))
add("communities_hierarchical", lambda r: G.hierarchical_communities(simple(r)))
add("community_profile", lambda r: G.communities(simple(r)).join(r.nodes.select("node_id", "node_type", "title"), "node_id").join(G.degrees(simple(r)).select("node_id", "degree"), "node_id").groupBy("community").agg(F.count("*").alias("n"), F.mode("node_type", True).alias("dominant"), F.max_by("title", F.struct("degree", "node_id")).alias("central")))


def _type_weight(c):
    out = F.lit(0.5)
    for k, v in TYPE_IMPORTANCE.items():
        out = F.when(c == k, v).otherwise(out)
    return out


_imp = "json_extract_string(metadata, '$.entity_type')"
add("importance_scores", lambda r: G.importance(r.nodes.join(G.degrees(simple(r)), "node_id", "left").select("node_id", F.get_json_object("metadata", "$.entity_type").alias("t"), (F.coalesce("degree", F.lit(0)) / (r.nodes.count() - 1)).alias("degree_centrality"), F.col("rank_score").alias("pagerank"), F.lit(0.95).alias("confidence")), _type_weight(F.col("t"))).select("node_id", _r("importance", 6).alias("importance")), f"SELECT n.node_id, round(0.3 * coalesce(degree, 0) / (SELECT count(*) - 1 FROM nodes) + 0.3 * coalesce(rank_score, 0) + 0.2 * 0.95 + 0.2 * CASE {_imp} WHEN 'COURT' THEN 1.0 WHEN 'JUDGE' THEN 0.9 WHEN 'PARTY' THEN 0.8 WHEN 'ATTORNEY' THEN 0.7 WHEN 'CASE' THEN 0.9 WHEN 'STATUTE' THEN 0.85 ELSE 0.5 END, 6) AS importance FROM nodes n LEFT JOIN degs d ON d.node_id = n.node_id")
add("top_entities", lambda r: G.degrees(simple(r)).join(G.pagerank(simple(r), r.nodes, 5), "node_id").select("node_id", "degree", _r(F.col("rank") * 1000, 5).alias("rank")).orderBy(F.desc("degree"), "node_id").limit(10), f"WITH {_pr}, {_prs} SELECT d.node_id, degree, round(x * 1000, 5) AS rank FROM degs d JOIN r5 ON r5.node_id = d.node_id ORDER BY degree DESC, d.node_id LIMIT 10")
add("analyze_graph", lambda r: G.basic_metrics(simple(r), r.nodes).select(F.explode(F.create_map(*(x for c in ("nodes", "edges", "density", "average_degree") for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", "value")).unionByName(G.transitivity(simple(r)).select(F.lit("transitivity").alias("metric"), F.col("transitivity").alias("value"))).unionByName(G.assortativity(simple(r)).select(F.lit("assortativity").alias("metric"), F.col("assortativity").alias("value"))).withColumn("value", _r("value", 6)))
add("graph_stats", lambda r: G.basic_metrics(simple(r), r.nodes).crossJoin(CC.connected_components(simple(r).select("a", "b")).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))))
same("visualization_subgraph", "WITH top AS (SELECT node_id FROM nodes ORDER BY rank_score DESC NULLS LAST, node_id LIMIT 100) SELECT e.edge_id, e.source, e.target FROM edges e JOIN top s ON s.node_id = e.source JOIN top t ON t.node_id = e.target")
same("list_entities_min_confidence", "SELECT entity_id, entity_type, confidence FROM entities WHERE confidence >= 0.7 ORDER BY confidence DESC, entity_id LIMIT 100")
add("graph_query_nested", lambda r: r.nodes.where("node_type = 'entity'").select("node_id", "title").join(r.edges.where("source is not null").groupBy(F.col("source").alias("node_id")).agg(F.sort_array(F.collect_list("target")).alias("targets")), "node_id").join(parts(r), "node_id", "left"), "SELECT n.node_id, title, targets, c AS community FROM nodes n JOIN (SELECT source, coalesce(list_sort(list(target) FILTER (target IS NOT NULL)), []) AS targets FROM edges WHERE source IS NOT NULL GROUP BY 1) e ON e.source = n.node_id LEFT JOIN (SELECT node_id, min(community_id) AS c FROM members GROUP BY 1) m ON m.node_id = n.node_id WHERE node_type = 'entity'")

# --- search
add("cosine_similarity", lambda r: _vectors(r).select("id", _r(C.cosine(F.col("vector"), S.vector_column(_query(r))), 4).alias("similarity")), _sim + " SELECT id, round(s, 4) AS similarity FROM v")
add("vector_distances", lambda r: _vectors(r).select("id", _r(C.l2_distance(F.col("vector"), S.vector_column(_query(r))), 4).alias("l2"), _r(C.dot(F.col("vector"), S.vector_column(_query(r))), 4).alias("inner_product")), f"SELECT vec_id AS id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST({_q} AS DOUBLE[])), 4) AS l2, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_q} AS DOUBLE[])), 4) AS inner_product FROM embeddings")
add("vector_normalize", lambda r: _vectors(r).select("id", _r(C.norm(C.normalised(F.col("vector"))), 6).alias("length")), "SELECT vec_id AS id, 1.0 AS length FROM embeddings")
add("vector_validate", lambda r: r.sql("SELECT embedding_id, vector FROM graph_embeddings").distinct().select("embedding_id", F.coalesce(F.size("vector") == 64, F.lit(False)).alias("right_size")), "SELECT DISTINCT embedding_id, coalesce(len(vector) = 64, false) AS right_size FROM graph_embeddings")
add("knn_cosine", lambda r: S.semantic(_vectors(r), _query(r), -1.0, 10).select("id", _r("similarity", 4).alias("similarity")), _sim + " SELECT id, round(s, 4) AS similarity FROM v ORDER BY s DESC, id LIMIT 10")
add("semantic_search", lambda r: S.semantic(_vectors(r), _query(r), 0.25, 10).select("id", _r("similarity", 4).alias("similarity")), _sim + " SELECT id, round(s, 4) AS similarity FROM v WHERE s >= 0.25 ORDER BY s DESC, id LIMIT 10")
add("similar_to_chunk", lambda r: S.semantic(_vectors(r).where("id > 0"), _query(r), 0.2, 5).select("id"), _sim + " SELECT id FROM v WHERE id > 0 AND s >= 0.2 ORDER BY s DESC, id LIMIT 5")
add("vector_threshold", lambda r: _vectors(r).where(1 - C.cosine(F.col("vector"), S.vector_column(_query(r))) < 0.8).select("id"), _sim + " SELECT id FROM v WHERE 1 - s < 0.8")
add("local_search", lambda r: S.local(_vectors(r), _vectors(r).where("label = 1").select("id"), _query(r), 0.1, 10).select("id"), _sim + " SELECT id FROM v WHERE label = 1 AND s >= 0.1 ORDER BY s DESC, id LIMIT 10")
_lab = lambda r: _vectors(r).where("id < 10").select(F.col("id").alias("community"), "vector")
add("global_search", lambda r: S.global_(_vectors(r), _lab(r), _vectors(r).select(F.col("label").cast("long").alias("community"), "id"), _query(r), 3, -1.0, 10).select("id", _r("relevance_score", 4).alias("relevance_score")), _sim + ", c AS (SELECT id, s FROM v WHERE id < 10 ORDER BY s DESC, id LIMIT 3) SELECT v.id, round(v.s * c.s, 4) AS relevance_score FROM v JOIN c ON c.id = v.label ORDER BY v.s * c.s DESC, v.id LIMIT 10")
add("search_all_scopes", lambda r: S.semantic(_vectors(r).where("label < 3"), _query(r), 0.1, 5).select("id", F.lit("low").alias("scope")).unionByName(S.semantic(_vectors(r).where("label >= 3"), _query(r), 0.1, 5).select("id", F.lit("high").alias("scope"))), _sim + " SELECT * FROM (SELECT id, 'low' AS scope FROM v WHERE label < 3 AND s >= 0.1 ORDER BY s DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT id, 'high' FROM v WHERE label >= 3 AND s >= 0.1 ORDER BY s DESC, id LIMIT 5)")
add("search_quality", lambda r: S.quality(S.semantic(_vectors(r), _query(r), 0.1, 10)).select(_r("quality", 4).alias("quality")), _sim + ", t AS (SELECT s FROM v WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 10) SELECT round(least(1.0, 0.7 * avg(s) + 0.2 * least(count(*) / 10, 1.0) + least(2 * var_pop(s), 0.2)), 4) AS quality FROM t")
add("involved_communities", lambda r: S.semantic(_vectors(r), _query(r), 0.2, 10).select("label").distinct(), _sim + " SELECT DISTINCT label FROM (SELECT label FROM v WHERE s >= 0.2 ORDER BY s DESC, id LIMIT 10)")
add("similar_entity_best", lambda r: _vectors(r).where("id > 0").groupBy("label").agg(F.max_by("id", F.struct(C.cosine(F.col("vector"), S.vector_column(_query(r))).alias("s"), (-F.col("id")).alias("i"))).alias("best")), _sim + " SELECT label, first(id ORDER BY s DESC, id) AS best FROM v WHERE id > 0 GROUP BY label")
_words = "'demurrage', 'strike', 'lien'"
_bm = f"WITH w AS (SELECT chunk_id AS id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM chunks), t AS (SELECT id, len(w) AS l, unnest(w) AS x FROM w), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w WHERE w IS NOT NULL OR true), tf AS (SELECT id, l, x, count(*) AS tf FROM t WHERE x IN ({_words}) GROUP BY ALL), df AS (SELECT x, count(*) AS df FROM tf GROUP BY x), bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (x), st GROUP BY id)"
_items = lambda r: r.chunks.select(F.col("chunk_id").alias("id"), "content")
add("bm25", lambda r: S.bm25(_items(r), "demurrage strike lien").select("id", _r("score", 4).alias("score")), _bm + " SELECT id, round(score, 4) AS score FROM bm")
add("rrf_ranks", lambda r: S.bm25(_items(r), "demurrage strike lien").select("id", F.row_number().over(Window.orderBy(F.desc(_r("score", 6)), "id")).alias("k")).where("k <= 50").select("id", _r(1.0 / (60 + F.col("k")), 6).alias("rrf")), _bm + " SELECT id, round(1.0 / (60 + k), 6) AS rrf FROM (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS k FROM bm) WHERE k <= 50")


def _hybrid_items(r: Relations):
    v = r.sql("SELECT DISTINCT source_id AS id, first(vector) AS vector FROM graph_embeddings WHERE size(vector) = 64 GROUP BY source_id")
    return _items(r).join(v, "id", "left")


add("hybrid_search", lambda r: S.hybrid(_hybrid_items(r), _query(r), "demurrage strike lien"))
add("search_with_level", lambda r: S.hybrid(_hybrid_items(r), _query(r), "tariff oral promise", alpha=0.7, limit=50))
add("precedent_search", lambda r: S.hybrid(_hybrid_items(r).join(r.chunks.select(F.col("chunk_id").alias("id"), "document_id"), "id").join(r.docs.where("source_schema = 'law'").select("document_id"), "document_id", "left_semi"), _query(r), "warranty lapsed", limit=15))
same("entity_chunks", "SELECT c.chunk_id, e.entity_id FROM chunks c JOIN entities e ON e.document_id = c.document_id WHERE e.entity_type = 'COURT' AND e.confidence >= 0.9 ORDER BY c.chunk_id, e.entity_id LIMIT 200")
same("citation_network", "SELECT c.citing, c.cited, d.title FROM cites c JOIN docs d ON d.document_id = c.cited WHERE d.document_type IN ('opinion', 'case_law')")
_chain = "SELECT a.citing AS first_id, a.cited AS second_id, b.cited AS third_id FROM cites a JOIN cites b ON b.citing = a.cited"
same("precedent_chain", _chain)
same("contradictions", "SELECT e.edge_id, s.title AS source_title, t.title AS target_title FROM edges e JOIN nodes s ON s.node_id = e.source JOIN nodes t ON t.node_id = e.target WHERE e.relationship_type IN ('OVERRULES', 'DISTINGUISHES', 'CONFLICTS_WITH')")
add("similar_chunks", lambda r: R.similar_topics(_vectors(r).where("label = 1").select(F.col("id").alias("chunk_id"), F.col("vector").alias("embedding")), 0.3).select("source_chunk_id", "target_chunk_id"), f"SELECT source_chunk_id, target_chunk_id FROM ({_self} AND a.label = 1) WHERE s >= 0.3")
same("rag_confidence", "SELECT document_id, round(0.3 * coalesce(chunk_count, 0) / 50.0 + 0.5 * least(1.0, coalesce(entity_count, 0) / 60.0) + 0.16, 6) AS confidence FROM docs")
same("context_quality", "SELECT document_id, round((CASE WHEN title IS NULL THEN 0 ELSE 1 END + CASE WHEN court_name IS NULL THEN 0 ELSE 1 END + CASE WHEN citation IS NULL THEN 0 ELSE 1 END + CASE WHEN client_id IS NULL THEN 0 ELSE 1 END) / 4.0, 4) AS quality FROM docs")
same("rag_synthesis", "SELECT document_id, concat_ws(' | ', 'Context: ' || title, 'Evidence: ' || citation, 'Reasoning: ' || document_type) AS answer FROM docs")

# --- chunks, validation, updates
_doc = "SELECT CAST(doc_id AS STRING) AS document_id, text FROM documents"
add("chunk_documents", lambda r: CH.chunk_documents(r.sql(_doc), 1000, 100).select("chunk_id", "chunk_index", "start_char", "end_char", "token_count"), "SELECT CAST(doc_id AS VARCHAR) || '-chunk-' || i AS chunk_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 900 AS INTEGER) AS start_char, CAST(least(i * 900 + 1000, length(text)) AS INTEGER) AS end_char, CAST(floor((least(i * 900 + 1000, length(text)) - i * 900) / 4) AS INTEGER) AS token_count FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) // 900 + 1)) AS i FROM documents WHERE text <> '')")
add("contextualize_chunks", lambda r: r.docs.where("title is not null").select("document_id", CH.contextualised(F.col("title"), F.col("created_year").cast("string"), F.col("document_type")).alias("context")), "SELECT document_id, 'Document: ' || title || ' (' || created_year || '). Context: ' || document_type AS context FROM docs WHERE title IS NOT NULL")
add("text_units", lambda r: CH.text_units(r.chunks.where("document_id is not null").groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("token_count")), r.chunks.join(r.entities.select("document_id", "entity_id"), "document_id").groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id"), F.collect_set("entity_id").alias("e")).select("chunk_id", F.explode("e").alias("entity_id"))).select("text_unit_id", "n_tokens", F.size("entity_ids").alias("n_entities")), "SELECT 'tu_' || c.chunk_id AS text_unit_id, n AS n_tokens, CAST(coalesce(k, 0) AS INTEGER) AS n_entities FROM (SELECT document_id, min(chunk_id) AS chunk_id, count(*) AS n FROM chunks WHERE document_id IS NOT NULL GROUP BY 1) c LEFT JOIN (SELECT document_id, count(DISTINCT entity_id) AS k FROM entities GROUP BY 1) e USING (document_id)")
same("community_reports", "SELECT community_id, concat('# ', title, ': ', coalesce(CAST(node_count AS {s}), '?'), ' nodes, ', coalesce(CAST(edge_count AS {s}), '?'), ' edges') AS report FROM comms", s="STRING || VARCHAR")
same("validate_orphans", "SELECT e.edge_id, CASE WHEN s.node_id IS NULL AND t.node_id IS NULL THEN 'both' WHEN s.node_id IS NULL THEN 'source' ELSE 'target' END AS missing FROM edges e LEFT JOIN nodes s ON s.node_id = e.source LEFT JOIN nodes t ON t.node_id = e.target WHERE s.node_id IS NULL OR t.node_id IS NULL")
same("validate_records", "SELECT document_id, CASE WHEN title IS NULL OR title = '' THEN 'no title' WHEN content_md IS NULL OR content_md = '' THEN 'no text' WHEN status IS NULL THEN 'no status' ELSE 'ok' END AS verdict FROM docs")
_split = "document_id is not null and source_schema = '{}'"
_ents = lambda r, s: r.entities.where(_split.format(s)).select("entity_id", "entity_text", "entity_type", "document_id")
_cnt = lambda df: df.groupBy("entity_type").agg(F.count("*").alias("n"))
add("update_graph_append", lambda r: _cnt(U.append(_ents(r, "law"), _ents(r, "client"))), "SELECT entity_type, count(*) AS n FROM entities WHERE document_id IS NOT NULL GROUP BY 1")
add("update_graph_replace", lambda r: _cnt(U.replace(_ents(r, "law"), _ents(r, "client"))), "SELECT entity_type, count(*) AS n FROM entities WHERE document_id IS NOT NULL AND (source_schema = 'client' OR document_id NOT IN (SELECT document_id FROM entities WHERE source_schema = 'client' AND document_id IS NOT NULL)) GROUP BY 1")
add("update_graph_smart", lambda r: _cnt(U.smart(_ents(r, "law"), _ents(r, "client"), "entity_text", "entity_type")), f"WITH e AS (SELECT entity_type, source_schema AS s, {_form} AS f FROM entities WHERE document_id IS NOT NULL) SELECT entity_type, count(*) AS n FROM (SELECT entity_type FROM e WHERE s = 'law' UNION ALL SELECT entity_type FROM (SELECT DISTINCT entity_type, f FROM e WHERE s = 'client') c WHERE NOT EXISTS (SELECT 1 FROM e WHERE s = 'law' AND e.f = c.f AND e.entity_type = c.entity_type)) GROUP BY 1")

QUERIES, ORACLE = P.queries, P.oracle
