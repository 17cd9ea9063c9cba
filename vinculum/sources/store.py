"""Sources and sinks: JSON scans, keyed writes over Parquet, SQL by text, catalog, files.

Writes give the new state of a table as a DataFrame; `swap()` puts it in place as a new version, so that readers see the
old or the new one.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SAFE = re.compile(r"^\s*(?:with\b.*\bselect|select|show|describe|explain)\b", re.I | re.S)
_DDL = re.compile(r"^\s*(create|alter|drop)\s+(table|view|database|schema)\b", re.I)


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Late-bound temporary views over the tables."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def scan_json(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df if limit is None else df.limit(limit)


def scan_get(df: DataFrame, key: str, filters: dict | None = None, columns: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Equality filters, then a page in the order of `key`."""
    out = reduce(lambda d, f: d.where(F.col(f[0]) == f[1]), (filters or {}).items(), df)
    return out.orderBy(key).offset(offset).limit(limit).select(*(columns or ["*"]))


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    given = reduce(lambda d, x: d.withColumn(x[0], F.coalesce(F.col(x[0]), x[1]) if x[0] in d.columns else x[1]), (defaults or {}).items(), rows)
    return table.unionByName(given, allowMissingColumns=True)


def check_key(rows: DataFrame, key: list[str]) -> None:
    if missing := [k for k in key if k not in rows.columns]:
        raise ValueError(f"on_conflict columns not in the records: {missing}")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], ignore_duplicates: bool = False) -> DataFrame:
    """Rows with a known key replace the table's (or are left out); others are added. Of equal keys in rows one counts."""
    check_key(rows, key)
    new = rows.dropDuplicates(key)
    if ignore_duplicates:
        return table.unionByName(new.join(table.select(*key), key, "left_anti").select(*table.columns))
    return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new, allowMissingColumns=True)


def cascade_delete(ids: DataFrame, id_col: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Each table without the rows of which any of the named columns holds one of the ids."""
    out = {}
    for name, (df, cols) in tables.items():
        for c in cols:
            df = df.join(ids.select(F.col(id_col).alias(c)).distinct(), c, "left_anti").select(*df.columns)
        out[name] = df
    return out


def swap(df: DataFrame, path: str) -> str:
    """Write a new version under `path` and return it; nothing of an older one is touched."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    return version


def sql(spark: SparkSession, text: str, params: dict | None = None) -> DataFrame:
    """A reading statement, its parameters bound by name (never put into the text)."""
    if not _SAFE.match(text):
        raise ValueError("sql: only reading statements")
    return spark.sql(text, args=params or {})


def ddl(spark: SparkSession, text: str) -> None:
    if not _DDL.match(text):
        raise ValueError("ddl: only create, alter or drop of a table, view or schema")
    spark.sql(text)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("row"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in tables.items()))


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, i, c, k) for t, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string")


def literals(df: DataFrame) -> DataFrame:
    """Each row as the value list of an INSERT: (insert_values)."""

    def one(c: str, t: str) -> Column:
        v = F.col(c)
        if t.startswith("array<"):
            text = F.concat(F.lit("'["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]'"))
        elif t in ("string",):
            text = F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))
        elif t.startswith("timestamp") or t == "date":
            text = F.concat(F.lit("'"), v.cast("string"), F.lit("'"))
        else:
            text = v.cast("string")
        return F.coalesce(text, F.lit("NULL"))

    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *(one(c, t) for c, t in df.dtypes)), F.lit(")")).alias("insert_values"))


def list_files(spark: SparkSession, path: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Names and lengths of the files under a folder, in order of name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy("name").offset(offset).limit(limit)
