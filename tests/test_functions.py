import math

import pytest
from pyspark.sql import functions as F

from vinculum.functions import columns as C
from vinculum.functions import similarity as S


def one(spark, col, **given):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())).select(col.alias("x")).first()["x"]


def test_ids_and_forms(spark):
    t = F.col("t")
    assert one(spark, C.entity_id(t, F.lit("COURT")), t="Supreme Court") == one(spark, C.entity_id(t, F.lit(" court ")), t=" supreme court ") == "entity_0ec776d88a9c750e"
    assert one(spark, C.canonical_form(t), t="  Acme  Widgets, Inc. ") == "acme widgets,"
    assert [one(spark, C.entity_description(t), t=k) for k in ("COURT", "CUSTOM_TYPE")] == ["Judicial body", "Custom Type"]


def test_occurrences_and_relevance(spark):
    t = F.col("t")
    assert one(spark, C.occurrences(t, F.lit("aa")), t="aaaa") == [1, 2, 3]
    assert one(spark, C.occurrence_count(t, F.lit("aa")), t="aaaa") == 3
    assert one(spark, C.occurrence_count(t, F.lit(r"a\E.b")), t=r"xa\E.b") == 1 and one(spark, C.occurrence_count(t, F.lit("")), t="x") == 0
    text = "contract contract contract early mention. the contract is central to this case."
    assert one(spark, C.relevance(t, F.lit("contract"), F.lit(0.95)), t=text) == pytest.approx(0.69)


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = d.select(C.cosine(F.col("a"), F.col("b")).alias("c"), C.l2_distance(F.col("a"), F.col("b")).alias("d"), C.normalised(F.col("a")).alias("n")).collect()
    assert [x["c"] for x in r] == [pytest.approx(1.0), 0.0, None]
    assert r[1]["d"] == pytest.approx(math.sqrt(2)) and r[0]["n"] == pytest.approx([0.6, 0.8]) and r[2]["n"] is None


def test_strings_without_builtin(spark):
    assert S.ratio("abcd", "abxd") == 75.0 and S.ratio("", "") == 100.0 and S.ratio("a", "") == 0.0
    assert S.token_set("new york mets", "york new") == 100.0 and S.token_set("", "a") == 0.0
    assert S.token_set("alpha beta", "alpha gamma") == pytest.approx(max(S.ratio("alpha beta", "alpha gamma"), S.ratio("alpha", "alpha beta"), S.ratio("alpha", "alpha gamma")))
    m = S.tfidf_matrix(["John Doe", "John Doe", "zzz", ""])
    assert (m @ m.T)[0, 1] == pytest.approx(1.0) and (m @ m.T)[0, 2] == 0.0 and m[3].sum() == 0
    d = spark.createDataFrame([("abcd", "abxd"), (None, "x")], "a string, b string")
    assert [r[0] for r in d.select(S.fuzzy_ratio(F.col("a"), F.col("b"))).collect()] == [75.0, None]


def test_questions(spark):
    t = F.col("t")
    assert one(spark, C.query_complexity(t), t=" ".join(["w"] * 11)) == "medium" and one(spark, C.query_complexity(t), t="  ") == "low"
    assert [one(spark, C.query_intent(t), t=x) for x in ("the plaintiff", "find precedent", "filing deadline", "who did", "zoning")] == ["case_specific", "precedent", "procedural", "contextual", "general_legal"]
    assert one(spark, C.query_intent(t, F.lit("c1")), t="zoning") == "case_specific"
