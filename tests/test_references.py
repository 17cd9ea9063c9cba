import datetime as dt

import pytest
from pyspark.sql import functions as F

from vinculum.operators import references as R

T = dt.datetime


def parent(spark, rows, keys=("k",)):
    cols = ", ".join(f"{k} string" for k in keys)
    return R.Parent(spark.createDataFrame(rows, f"{cols}, status string, created_at timestamp, updated_at timestamp, reason string"), list(keys), F.col("status") == "deleted")


def child(spark, rows, cols=("p",), match="simple"):
    return R.Reference("t.p", spark.createDataFrame(rows, f"row string, {', '.join(f'{c} string' for c in cols)}, created_at timestamp, reason string"), "row", list(cols), match=match)


def found(p, refs):
    return {(r["row_id"], r["period"], r["reason"]) for r in R.find_orphans(p, refs).collect()}


def test_reasons(spark):
    p = parent(spark, [
        ("A", None, T(2020, 1, 1), T(2020, 1, 1), ""), ("b", None, T(2020, 1, 1), T(2020, 1, 1), ""), ("b", "deleted", T(2020, 1, 1), T(2020, 2, 1), ""),
        ("c", None, T(2022, 1, 1), T(2022, 1, 1), ""), ("d", "deleted", T(2020, 1, 1), T(2020, 1, 1), ""), ("d", "undeleted", T(2020, 1, 1), T(2020, 3, 1), ""), (None, None, None, None, ""),
    ])
    c = child(spark, [("1", " a\t", T(2021, 5, 1), ""), ("2", "B", T(2021, 5, 2), ""), ("3", "c", T(2021, 6, 1), ""), ("4", "d", T(2021, 6, 1), ""), ("5", "zz", T(2021, 7, 1), ""),
                      ("5", "zz", T(2021, 7, 1), ""), ("6", " ", T(2021, 7, 1), ""), ("7", None, None, ""), ("8", "c", None, ""), ("9", "zz", None, "")])
    assert found(p, [c]) == {("2", "2021-05", "deleted"), ("3", "2021-06", "late"), ("5", "2021-07", "missing"), ("9", None, "missing")}
    assert {r["row"] for r in R.clean_references(p, c).collect()} == {"1", "4", "6", "7", "8"}
    assert R.orphan_report(R.find_orphans(p, [c])).count() == 4


@pytest.mark.parametrize("match,want", [("simple", {"full"}), ("full", {"full", "half", "other"}), ("partial", {"full", "other"})])
def test_null_masks(spark, match, want):
    day = T(2020, 1, 1)
    p = parent(spark, [("x", "1", None, day, day, ""), ("y", "2", None, day, day, "")], ("a", "b"))
    c = child(spark, [("ok", "x", "1", day, ""), ("full", "x", "2", day, ""), ("half", "y", None, day, ""), ("other", None, "3", day, ""), ("none", None, None, day, "")], ("p", "q"), match)
    assert {r[0] for r in found(p, [c])} == want


def test_hot_key_and_empty(spark):
    day = T(2020, 1, 1)
    p = parent(spark, [("hot", "deleted", day, day, ""), ("cold", None, day, day, "")])
    c = child(spark, [(str(i), "hot" if i % 3 else "cold", day, "") for i in range(300)])
    assert len(found(p, [c])) == 200
    none = child(spark, [])
    assert found(p, [none]) == set()
    assert len(found(parent(spark, []), [c])) == 300
    with pytest.raises(ValueError):
        R.find_orphans(p, [child(spark, [], ("p", "q"))])
