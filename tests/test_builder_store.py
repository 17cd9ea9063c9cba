import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vinculum.sources import store
from vinculum.sources.builder import Query

ROWS = [("a", 1, None, ["x", "y"], '{"k": {"d": 2}, "s": "v"}', "Notice of default."), ("b", 2, "c1", ["x"], '{"k": {"d": 3}}', "no notice"), ("c", None, "c2", None, None, None), ("d", 4, "c1", [], "{}", "Default notice")]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, "id string, n int, client_id string, tags array<string>, meta string, txt string")


def ids(q):
    return [r["id"] for r in q.df().orderBy("id").collect()]


@pytest.mark.parametrize("call,want", [
    (lambda q: q.eq("n", 1), ["a"]), (lambda q: q.neq("n", 1), ["b", "d"]), (lambda q: q.gt("n", 1).lt("n", 4), ["b"]), (lambda q: q.gte("n", 2).lte("n", 4), ["b", "d"]), (lambda q: q.like("txt", "No%"), ["a"]),
    (lambda q: q.ilike("txt", "no%"), ["a", "b"]), (lambda q: q.is_("n", "null"), ["c"]), (lambda q: q.is_("n", "not.null"), ["a", "b", "d"]), (lambda q: q.in_("id", ["a", "d"]), ["a", "d"]), (lambda q: q.range_("n", 2, 4), ["b", "d"]),
    (lambda q: q.contains("tags", ["x", "y"]), ["a"]), (lambda q: q.contains("meta", {"k": {"d": 2}}), ["a"]), (lambda q: q.contained_by("tags", ["x"]), ["b", "d"]), (lambda q: q.tenant("c1"), ["b", "d"]),
    (lambda q: q.tenant("c1", public=True), ["a", "b", "d"]), (lambda q: q.text_search("txt", "notice default"), ["a", "d"]), (lambda q: q.or_ilike({"id": "b", "txt": "default%"}), ["b", "d"]),
])
def test_filters(df, call, want):
    assert ids(call(Query(df))) == want


def test_order_pages_and_single(df):
    q = lambda: Query(df).order("n", desc=True)
    assert [r["id"] for r in q().df().collect()] == ["d", "b", "a", "c"]
    first, second = [r["id"] for r in q().range(0, 1).df().collect()], [r["id"] for r in q().range(2, 3).df().collect()]
    assert not set(first) & set(second) and len(first) == len(second) == 2
    assert Query(df).gt("n", 1).limit(1).count().first()["count"] == 2
    assert Query(df).eq("id", "a").single()["n"] == 1 and Query(df).eq("id", "q").maybe_single() is None
    for bad in (lambda: Query(df).single(), lambda: Query(df).maybe_single(), lambda: Query(df).is_("n", "maybe")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(AnalysisException):
        Query(df).eq("nope", 1).df()


def test_writes(df, tmp_path, spark):
    assert {r["id"]: r["n"] for r in Query(df).eq("client_id", "c1").update(n=9).collect()} == {"a": 1, "b": 9, "c": None, "d": 9}
    assert [r["id"] for r in Query(df).eq("n", 1).delete().orderBy("id").collect()] == ["b", "c", "d"]
    t, new = df.select("id", "n"), spark.createDataFrame([("a", 7), ("z", 8), ("z", 8)], "id string, n int")
    assert {r["id"]: r["n"] for r in store.upsert(t, new, ["id"]).collect()} == {"a": 7, "b": 2, "c": None, "d": 4, "z": 8}
    assert {r["id"]: r["n"] for r in store.upsert(t, new, ["id"], True).collect()} == {"a": 1, "b": 2, "c": None, "d": 4, "z": 8}
    with pytest.raises(ValueError, match="nod_id"):
        store.upsert(t, new, ["nod_id"])
    out = store.cascade_delete(spark.createDataFrame([("a",)], "id string"), "id", {"t": (t, ["id"])})
    assert out["t"].count() == 3
    assert spark.read.parquet(store.swap(t, str(tmp_path))).count() == 4
    assert store.insert(t, spark.createDataFrame([("y",)], "id string"), {"n": F.lit(5)}).where("id = 'y'").first()["n"] == 5


def test_sql_and_literals(df, spark):
    df.createOrReplaceTempView("t_sql")
    assert store.sql(spark, "select id from t_sql where n = :n", {"n": 2}).first()["id"] == "b"
    for bad in ("drop table t_sql", "insert into t_sql values (1)"):
        with pytest.raises(ValueError):
            store.sql(spark, bad)
    with pytest.raises(ValueError):
        store.ddl(spark, "delete from t_sql")
    d = spark.createDataFrame([("it's", None, [1.0, 2.0], True)], "s string, n int, v array<double>, b boolean")
    assert store.literals(d).first()[0] == "('it''s', NULL, '[1.0,2.0]', true)"
    assert store.row_counts({"x": df}).first()["n"] == 4 and store.json_rows(df).count() == 4
