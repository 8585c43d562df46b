"""Readers (S1, S4, S5, S6, S7).

CSV is read as text, pandas' missing-value tokens are mapped to NULL, and
column types are chosen from one aggregate of trial casts (integer, float,
boolean, else text), the way pandas infers; that aggregate is a pass over the
file of its own.  JSON nested objects are flattened to dotted column names.
"""

from __future__ import annotations

from collections import Counter
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import as_number
from ledgerlens.operators._common import q
from ledgerlens.session import scratch_path
from ledgerlens.sources import archives, documents, quoted

# Text pandas' CSV reader treats as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
BOOL_TEXT = {"true": True, "false": False, "True": True, "False": False, "TRUE": True, "FALSE": False}


def _na_to_null(c):
    return F.when(F.col(c).isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(c))


def infer_types(df: DataFrame) -> DataFrame:
    """Cast all-text columns to long / double / boolean when every present value parses."""
    cols = df.columns
    checks = []
    for i, c in enumerate(cols):
        x = F.trim(F.col(q(c)))
        checks += [F.count(F.col(q(c))).alias(f"n{i}"), F.count(x.try_cast("long")).alias(f"l{i}"),
                   F.count(as_number(x)).alias(f"d{i}"),
                   F.count_if(F.col(q(c)).isin(*BOOL_TEXT)).alias(f"b{i}")]
    row = df.agg(*checks).first()
    out = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        x = F.trim(F.col(q(c)))
        if n and row[f"l{i}"] == n:
            out.append(x.try_cast("long").alias(c))
        elif n and row[f"d{i}"] == n:
            out.append(as_number(x).alias(c))
        elif n and row[f"b{i}"] == n:
            out.append(F.col(q(c)).isin("true", "True", "TRUE").alias(c))
        else:
            out.append(F.col(q(c)))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", header: bool = True,
             infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    """CSV/TXT with a header row; undecodable bytes replaced; pandas-like types and nulls.

    Quoted fields may hold line breaks.  Whether any does is found in a pass over the file
    (``multi_line`` says so beforehand); if so, the records are put together by many tasks (see
    ``quoted``), else Spark's reader splits at every line break.  Both give each record to the
    same parser.
    """
    options = {"sep": sep, "mode": "PERMISSIVE", "escape": '"', "nullValue": "\u0000never\u0000", "emptyValue": ""}
    reader = spark.read.options(**options).option("header", header).option("encoding", encoding).option("inferSchema", False)
    records = None if multi_line is False else quoted.quoted_records(spark, path, sep, encoding, always=bool(multi_line))
    if records is None:
        raw = reader.csv(path)
    else:
        names = reader.option("multiLine", True).csv(path).columns  # reads the first record
        text = F.regexp_replace("value", "\r$", "")
        kept = records.where(F.trim("value") != "") if not header else records.where((F.trim("value") != "") & ~F.col("first"))
        kind = ", ".join(f"c{i} STRING" for i in range(len(names)))
        raw = kept.select(F.from_csv(text, F.lit(kind), options).alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    names = [f"Unnamed: {i}" if c == f"_c{i}" else c for i, c in enumerate(raw.columns)]
    raw = raw.toDF(*names)
    clean = raw.select(*[_na_to_null(q(c)).alias(c) for c in raw.columns])
    return infer_types(clean) if infer else clean


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields become top-level columns named ``a.b.c``; arrays stay as they are."""
    def walk(dt: T.DataType, path: list[str]):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                yield from walk(f.dataType, path + [f.name])
        else:
            yield path
    cols = []
    for f in df.schema.fields:
        for p in walk(f.dataType, [f.name]):
            ref = F.col("`" + p[0] + "`")
            for part in p[1:]:
                ref = ref.getField(part)
            cols.append(ref.alias(sep.join(p)))
    return df.select(*cols)


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines (default) or JSON documents, one per file (``multi_line=True``); both are split between tasks.

    Each document contributes the elements of its root list, else of its own
    *first* list-valued key (in document order), else itself; nested objects
    are flattened to dotted names.  See ``documents``.
    """
    return _json_rows(documents.element_lines(spark, path)) if multi_line else flatten(spark.read.json(path))


def _json_rows(rows: DataFrame) -> DataFrame:
    """Rows of JSON text, one line or many, as a flat table: written once as JSON lines, so that Spark finds the columns of all of them."""
    path = scratch_path(rows.sparkSession, "json-rows")
    rows.select("value").write.text(path)
    return flatten(rows.sparkSession.read.json(path))


def archive_members(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The records of every CSV/JSON member of the zip files under ``path`` (a folder or one file); see ``archives``.

    CSV records come as ``fields`` (row 0 is the header; quoted line breaks
    stay inside a field), JSON rows as text in ``value`` under the rule of
    :func:`read_json`.  Folders, ``__MACOSX`` entries and other suffixes are
    skipped.  An archive or member that cannot be read gives a row with
    ``error``, and the others are read on.
    """
    spark.dataSource.register(archives.ZipMembers)
    return spark.read.format(archives.ZipMembers.name()).option("sep", sep).load(path)


def archive_tables(spark: SparkSession, path: str, sep: str = ",") -> tuple[dict[str, DataFrame], DataFrame]:
    """One DataFrame per member, and the (archive, member, error) rows of what could not be read and is left out.

    Tables are named by member, or ``archive/member`` where archives share a member name.
    """
    store = scratch_path(spark, "archives")
    archive_members(spark, path, sep).write.parquet(store)
    rows = spark.read.parquet(store)
    failed = rows.where("error IS NOT NULL").select("archive", "member", "error")
    heads = (rows.where("row_no = 0").join(failed, ["archive", "member"], "left_anti").select("archive", "member", "fields")
             .orderBy("archive", "member").collect())  # one row per member
    shared = Counter(h["member"] for h in heads)
    out: dict[str, DataFrame] = {}
    for h in heads:
        name = h["member"] if shared[h["member"]] == 1 else f"{PurePosixPath(h['archive']).name}/{h['member']}"
        mine = rows.where((F.col("archive") == h["archive"]) & (F.col("member") == h["member"]))
        out[name] = _json_rows(mine) if h["fields"] is None else _csv_rows(mine, h["fields"])
    return out, failed


def archive_table(spark: SparkSession, path: str, member: str, sep: str = ",") -> DataFrame:
    """The rows of one CSV member name in all archives under ``path`` as one table, by the columns of its first header.

    Archives need the same columns (their order is taken from the first); one plan, however many archives there are.
    """
    store = scratch_path(spark, "archives")
    archive_members(spark, path, sep).where(F.col("member") == member).write.parquet(store)
    rows = spark.read.parquet(store)
    bad = rows.where("error IS NOT NULL").select("archive", "error").first()
    if bad is not None:
        raise ValueError(f"{bad['archive']}: {bad['error']}")
    heads = rows.where("row_no = 0").groupBy("fields").agg(F.min("archive").alias("archive")).orderBy("archive").limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"{member!r} has {'no' if not heads else 'more than one'} header")
    return _csv_rows(rows, heads[0]["fields"])


def _csv_rows(rows: DataFrame, header: list[str]) -> DataFrame:
    body = rows.where("row_no > 0").select(*[F.get("fields", F.lit(i)).alias(c or f"Unnamed: {i}") for i, c in enumerate(header)])
    return infer_types(body.select(*[_na_to_null(q(c)).alias(c) for c in body.columns]))


def read_jdbc_tables(spark: SparkSession, url: str, tables: list[str], properties: dict | None = None,
                     limit: int | None = None, partition: dict | None = None) -> dict[str, DataFrame]:
    """Every listed table of a database; ``limit`` is pushed into the source query.

    ``partition`` = {table: (column, lower, upper, num_partitions)} reads a big
    table with parallel range queries instead of one connection.
    """
    props = dict(properties or {})
    out = {}
    for t in tables:
        reader = spark.read.format("jdbc").option("url", url).options(**props)
        if partition and t in partition:
            col, lo, hi, n = partition[t]
            reader = (reader.option("dbtable", t).option("partitionColumn", col).option("lowerBound", lo)
                      .option("upperBound", hi).option("numPartitions", n))
        elif limit:
            reader = reader.option("query", f"SELECT * FROM {t} LIMIT {int(limit)}")
        else:
            reader = reader.option("dbtable", t)
        out[t] = reader.load()
    return out


def read_jdbc_query(spark: SparkSession, url: str, sql: str, properties: dict | None = None) -> DataFrame:
    """The result of one SQL query run by the database."""
    return spark.read.format("jdbc").option("url", url).options(**dict(properties or {})).option("query", sql).load()
