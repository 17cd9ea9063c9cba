"""discover_relationships has all four stages, and leaves out what the edges say already."""

import itertools
from collections import Counter

from pyspark.sql import functions as F

from vinculum.constants import KEYWORDS, TYPE_RULES
from vinculum.operators import relations as R
from vinculum.plans.graphs import QUERIES

ENTITIES = [
    ("Acme v. Baker", "case", "d1"), ("Acme v. Baker", "case", "d2"), ("Judge Stone", "judge", "d1"), ("judge stone ", "judge", "d2"), ("High Court", "court", "d1"), ("High Court", "court", "d3"),
    ("Harwick", "location", "d1"), ("Harwick", "person", "d2"), ("Lone Mill", "organization", None), ("Cole v. Dunn", "case", "d3"), (" ", "person", "d1"),
]
CITES = [("D1 ", "Acme v. Baker, 12 Rptr. 3d 4", 3), ("d1", "ACME V. BAKER at Harwick", None), ("d2", "Cole v. Dunn, 8 Rptr. 2d 1", 1), ("d3", "High Court rules", 2), (None, "Harwick", 1), ("d3", None, 1)]
CHUNKS = [
    "Acme v. Baker came before the High Court.", "Judge Stone of the HIGH COURT sat in Harwick.", "Lone Mill, which owns Harwick, and acme v. baker; Harwick again.", "Harwick is a subsidiary of Lone Mill", "Lone Mill employee Harwick",
    "Lone Mill", None, "Cole v. Dunn overrules Acme v. Baker", "High Court in Harwick under Judge Stone", "High Court, Harwick", "Judge Stone governs Lone Mill",
]
EDGES = [("n1", "n2", "CITES"), ("n2", "n1", "CITES"), ("n3", "n4", "OWNS"), ("n3", "gone", "EMPLOYS")]
NODES = [("n1", "Acme v. Baker"), ("n2", "COLE v. Dunn"), ("n3", "Harwick"), ("n4", "Lone Mill ")]


def frame(spark, rows, schema, rest):
    df = spark.createDataFrame(rows, schema)
    for x in rest.split(", "):
        c, t = x.split()
        df = df.withColumn(c, F.lit(None).cast(t))
    return df


def by_hand():
    low = lambda x: x.lower().strip()
    docs, kinds, found = {}, {}, set()
    for text, kind, d in ENTITIES:
        kinds.setdefault(low(text), set()).add(kind.upper())
        docs.setdefault(d, set()).add(low(text))
    docs.pop(None)
    for d, text, _ in CITES:
        own = docs.get(low(d or ""), set()) if text else set()
        found |= {(x, y, "CITED_TOGETHER") for x in own for y in own if x and x in text.lower() and x != y}
    together = Counter(p for own in docs.values() for p in itertools.combinations(sorted(own), 2))
    found |= {(*p, "CROSS_DOCUMENT_ASSOCIATION") for p, n in together.items() if n >= 2}
    shared = Counter()
    for text in filter(None, CHUNKS):
        text = text.lower()
        for x, y in itertools.combinations(sorted(e for e in kinds if e and e in text), 2):
            shared[x, y] += 1
            for s, t in itertools.product(kinds[x], kinds[y]):
                rule = [k for a, b, k in TYPE_RULES if {(a, b), (b, a)} & {(s, t)}]
                lo, hi = sorted((text.find(x), text.find(y)))
                rule += [k for k, words in KEYWORDS if any(w in text and lo < text.find(w) < hi for w in words)]
                found |= {(x, y, k) for k in rule[:1]}
    found |= {(*p, "FREQUENTLY_COOCCURS") for p, n in shared.items() if n >= 3}
    title = {n: low(t) for n, t in NODES}
    known = {(title.get(a), title.get(b), k) for a, b, k in EDGES}
    assert found & known
    return Counter(k for *_, k in found - known)


def test_four_stages_are_counted(spark, tmp_path):
    tables = {
        "raw_entities": frame(spark, [(f"r{i}", *x) for i, x in enumerate(ENTITIES)], "entity_id string, entity_text string, entity_type string, document_id string", "canonical_name string, confidence_score double, source_schema string, case_id string"),
        "law_citations": frame(spark, [(f"c{i}", *x) for i, x in enumerate(CITES)], "id string, citing_document_id string, citation_text string, page_number int", "cited_document_id string"),
        "graph_chunks": frame(spark, [(f"k{i}", x) for i, x in enumerate(CHUNKS)], "chunk_id string, content string", "document_id string, chunk_index int, content_type string, token_count int, chunk_size int, overlap_size int, client_id string"),
        "graph_edges": frame(spark, [(f"e{i}", *x) for i, x in enumerate(EDGES)], "edge_id string, source_node_id string, target_node_id string, relationship_type string", "weight double, confidence_score double, extraction_method string, evidence string"),
        "graph_nodes": frame(spark, NODES, "node_id string, title string", "node_type string, description string, source_type string, node_degree int, rank_score double, client_id string, metadata string, created_at timestamp, updated_at timestamp"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["relationship_type"]: r["n"] for r in QUERIES["discover_relationships"](spark, str(tmp_path)).collect()}
    want = by_hand()
    assert {"CITED_TOGETHER", "CROSS_DOCUMENT_ASSOCIATION", "FREQUENTLY_COOCCURS", "PRESIDES", "OWNS"} <= set(want) and got == want


def test_undirected_relations_are_known_both_ways(spark):
    rows = [("a", "b", "AFFILIATES"), ("a", "b", "CITES")]
    got = R.relation_index(spark.createDataFrame(rows, "source_id string, target_id string, relationship_type string")).collect()
    assert sorted(map(tuple, got)) == sorted([*rows, ("b", "a", "AFFILIATES")])
