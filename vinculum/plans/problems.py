"""Queries of the general problems p1 (references to records that do not exist) and p5 (hierarchies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.operators import hierarchy as H
from vinculum.operators import references as R
from vinculum.session import table


def node_parent(spark: SparkSession, d: str) -> R.Parent:
    return R.Parent(table(spark, d, "graph_nodes"), ["node_id"], F.get_json_object("metadata", "$.status") == "deleted")


def document_parent(spark: SparkSession, d: str) -> R.Parent:
    return R.Parent(table(spark, d, "document_registry"), ["document_id"], F.col("status") == "deleted")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "graph_edges")
    ends = [R.Reference(f"graph_edges.{c}", edges, "edge_id", [c]) for c in ("source_node_id", "target_node_id")]
    chunks = R.Reference("graph_chunks.document_id", table(spark, d, "graph_chunks"), "chunk_id", ["document_id"])
    cited = R.Reference("law_citations.cited_document_id", table(spark, d, "law_citations"), "id", ["cited_document_id"])
    return R.find_orphans(node_parent(spark, d), ends).unionByName(R.find_orphans(document_parent(spark, d), [chunks, cited]))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(p1_found(spark, d))


def p1_composite(spark: SparkSession, d: str) -> DataFrame:
    """Entities name a document by (source_schema, document_id); either may be null: partial match."""
    docs = table(spark, d, "document_registry")
    parent = R.Parent(docs, ["source_schema", "document_id"], F.col("status") == "deleted")
    ref = R.Reference("raw_entities.(source_schema,document_id)", table(spark, d, "raw_entities"), "entity_id", ["source_schema", "document_id"], match="partial")
    return R.find_orphans(parent, [ref])


def _links(spark: SparkSession, d: str) -> DataFrame:
    return H.current_links(table(spark, d, "graph_communities"), "community_id", "parent_community_id", "updated_at", "created_at")


def _communities(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_links(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _communities(spark, d).withColumnRenamed("id", "community_id")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(_links(spark, d)).withColumnRenamed("id", "community_id")


def p5_trees(spark: SparkSession, d: str) -> DataFrame:
    return H.tree_report(_communities(spark, d))


def p5_wrong_levels(spark: SparkSession, d: str) -> DataFrame:
    """Communities whose declared level is not their depth; a null level is wrong too."""
    level = table(spark, d, "graph_communities").groupBy("community_id").agg(F.max(F.struct("updated_at", "created_at", "level")).alias("s"))
    level = level.select("community_id", F.col("s.level").alias("level"))
    return p5_found(spark, d).join(level, "community_id").where("state = 'tree' and not (level <=> depth)").select("community_id", "level", "depth")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_composite, p5_found, p5_descendants, p5_trees, p5_wrong_levels)}

_ID = r"nullif(lower(trim({}, e' \t\r\n')), '')"
_P1 = rf"""
nodes AS (SELECT {_ID.format('node_id')} AS k, arg_max(coalesce(json_extract_string(metadata, '$.status') = 'deleted', false), updated_at) AS dead, arg_max(created_at, updated_at) AS born FROM graph_nodes GROUP BY 1),
docs AS (SELECT {_ID.format('document_id')} AS k, arg_max(coalesce(status = 'deleted', false), updated_at) AS dead, arg_max(created_at, updated_at) AS born FROM document_registry GROUP BY 1),
refs AS (
  SELECT 'graph_edges.source_node_id' AS ref_field, edge_id AS row_id, created_at, {_ID.format('source_node_id')} AS k FROM graph_edges
  UNION SELECT 'graph_edges.target_node_id', edge_id, created_at, {_ID.format('target_node_id')} FROM graph_edges
  UNION SELECT 'graph_chunks.document_id', chunk_id, created_at, {_ID.format('document_id')} FROM graph_chunks
  UNION SELECT 'law_citations.cited_document_id', id, created_at, {_ID.format('cited_document_id')} FROM law_citations),
parents AS (SELECT 'n' AS side, * FROM nodes WHERE k IS NOT NULL UNION ALL SELECT 'd', * FROM docs WHERE k IS NOT NULL),
failed AS (
  SELECT ref_field, row_id, strftime(r.created_at AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN p.dead THEN 'deleted' WHEN p.born > r.created_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN parents p ON p.k = r.k AND p.side = CASE WHEN ref_field LIKE 'graph_edges%' THEN 'n' ELSE 'd' END
  WHERE r.k IS NOT NULL),
found AS (SELECT DISTINCT * FROM failed WHERE reason IS NOT NULL)"""

_P5 = rf"""
latest AS (SELECT {_ID.format('community_id')} AS id, arg_max(struct_pack(p := {_ID.format('parent_community_id')}), updated_at).p AS parent, arg_max(struct_pack(l := level), updated_at).l AS level FROM graph_communities GROUP BY 1),
up AS (SELECT c.id, c.parent, c.level, p.id IS NOT NULL AS linked FROM latest c LEFT JOIN latest p ON p.id = c.parent),
walk(id, cur, trail) AS (
  SELECT id, id, [id] FROM up
  UNION ALL
  SELECT w.id, u.parent, list_append(w.trail, u.parent) FROM walk w JOIN up u ON u.id = w.cur WHERE u.linked AND NOT list_contains(w.trail, u.parent)),
last AS (SELECT id, arg_max(cur, len(trail)) AS cur, arg_max(trail, len(trail)) AS trail FROM walk GROUP BY id),
ended AS (SELECT l.id, l.trail, u.linked, u.parent, list_position(l.trail, u.parent) AS meets FROM last l JOIN up u ON u.id = l.cur),
tree AS (
  SELECT id AS community_id,
    CASE WHEN linked AND meets = 1 THEN 'cycle' WHEN linked THEN 'below_cycle' WHEN parent IS NOT NULL THEN 'dangling' ELSE 'tree' END AS state,
    CASE WHEN linked THEN list_min(trail[meets:]) ELSE trail[-1] END AS root_id,
    CAST(CASE WHEN linked THEN meets - 1 ELSE len(trail) - 1 END AS INTEGER) AS depth,
    array_to_string(list_reverse(CASE WHEN linked THEN trail[:meets] ELSE trail END), '/') AS path
  FROM ended)"""

ORACLE = {
    "p1_found": f"WITH {_P1} SELECT * FROM found",
    "p1_report": f"WITH {_P1} SELECT ref_field, period, reason, count(*) AS n_refs, count(DISTINCT row_id) AS n_rows FROM found GROUP BY ALL",
    "p1_composite": rf"""WITH docs AS (SELECT {_ID.format('source_schema')} AS k0, {_ID.format('document_id')} AS k1, arg_max(coalesce(status = 'deleted', false), updated_at) AS dead, arg_max(created_at, updated_at) AS born FROM document_registry GROUP BY 1, 2),
refs AS (SELECT DISTINCT entity_id AS row_id, created_at, {_ID.format('source_schema')} AS k0, {_ID.format('document_id')} AS k1 FROM raw_entities),
agreed AS (SELECT r.row_id, r.created_at, count(d.born) AS n, coalesce(bool_or(NOT d.dead), false) AS live, min(d.born) FILTER (NOT d.dead) AS born
  FROM refs r LEFT JOIN docs d ON (r.k0 IS NULL OR r.k0 = d.k0) AND (r.k1 IS NULL OR r.k1 = d.k1) WHERE r.k0 IS NOT NULL OR r.k1 IS NOT NULL GROUP BY ALL)
SELECT DISTINCT 'raw_entities.(source_schema,document_id)' AS ref_field, row_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS period, CASE WHEN n = 0 THEN 'missing' WHEN NOT live THEN 'deleted' ELSE 'late' END AS reason
FROM agreed WHERE n = 0 OR NOT live OR born > created_at""",
    "p5_found": f"WITH RECURSIVE {_P5} SELECT * FROM tree",
    "p5_descendants": f"WITH RECURSIVE {_P5}, pairs AS (SELECT id, unnest(trail) AS ancestor_id, generate_subscripts(trail, 1) - 1 AS distance FROM last) SELECT ancestor_id, id AS community_id, CAST(distance AS INTEGER) AS distance FROM pairs WHERE distance > 0",
    "p5_trees": f"WITH RECURSIVE {_P5} SELECT root_id, count(*) AS n_nodes, max(depth) AS max_depth, count(*) FILTER (state = 'tree') AS n_tree, count(*) FILTER (state = 'dangling') AS n_dangling, count(*) FILTER (state = 'cycle') AS n_cycle, count(*) FILTER (state = 'below_cycle') AS n_below_cycle FROM tree GROUP BY root_id",
    "p5_wrong_levels": f"WITH RECURSIVE {_P5} SELECT t.community_id, u.level, t.depth FROM tree t JOIN up u ON u.id = t.community_id WHERE state = 'tree' AND u.level IS DISTINCT FROM t.depth",
}
