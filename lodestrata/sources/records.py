"""Readers and writers of labelled records: JSON lines, JSON, CSV and Parquet, with the loader's alternative field names."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.texts import has_text, name_of

ALIASES = {"func": ["func", "function", "code"], "target": ["target", "label"], "project": ["project", "repo"], "name": ["name"], "cwe": ["cwe"], "commit_id": ["commit_id"]}
SCHEMA = "func string, target int, project string, name string, cwe string, commit_id string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of a file by its extension (S1): .jsonl, .json (a list, or an object whose ``data`` is one), .csv, .parquet."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".jsonl":
        return spark.read.json(path)
    if kind == ".json":
        df = spark.read.json(path, multiLine=True)
        return df.select(F.explode("data").alias("r")).select("r.*") if df.columns == ["data"] else df
    if kind == ".csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


def _label(c: Column) -> Column:
    """0 or 1 of a number, a boolean or a text of either."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text == "true", 1).when(text == "false", 0).otherwise(text.try_cast("double").cast("int"))


def resolve_aliases(df: DataFrame) -> DataFrame:
    """The loader's columns from whichever alternative names exist.

    An empty text falls through to the next name; rows without any text are dropped; a missing label is 0, a missing
    project 'unknown', other missing texts are empty (a null commit names no commit).
    """

    def first(field: str) -> Column:
        found = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ALIASES[field] if c in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    texts = [F.coalesce(first(k), F.lit("")).alias(k) for k in ("name", "cwe", "commit_id")]
    out = df.select(first("func").alias("func"), F.coalesce(_label(first("target")), F.lit(0)).alias("target"), F.coalesce(first("project"), F.lit("unknown")).alias("project"), *texts)
    return out.filter(F.col("func").isNotNull())


PAYLOAD = "func string, function string, code string, target string, label string, project string, repo string, name string, cwe string, commit_id string, _bad string"


def parse_payloads(df: DataFrame, payload_col: str, *keep: str) -> DataFrame:
    """Rows of a column of JSON objects with the loader's columns; rows that aren't valid JSON are dropped."""
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    parsed = df.select(*keep, F.from_json(payload_col, PAYLOAD, options).alias("r")).select(*keep, "r.*").filter("_bad IS NULL")

    def first(field: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ALIASES[field]])

    out = parsed.select(*keep, first("func").alias("func"), _label(first("target")).alias("target"), F.coalesce(first("project"), F.lit("unknown")).alias("project"), *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("name", "cwe", "commit_id")])
    return out.filter(F.col("func").isNotNull())


def only_projects(df: DataFrame, projects: list[str]) -> DataFrame:
    """Rows of the given projects; all rows for an empty list."""
    return df.filter(F.col("project").isin(projects)) if projects else df


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def acquire(spark: SparkSession, config: dict) -> DataFrame:
    """Records by ``config['source']`` (S7): 'file' with ``path``, or 'release' with Parquet ``paths``.

    A missing source means 'file'. The release's labels are booleans; its texts are kept once each, blank ones dropped.
    """
    from lodestrata.plans.corpus import first_copies

    source = config.get("source") or "file"
    if source == "file":
        return only_projects(resolve_aliases(read_records(spark, config["path"])), config.get("projects") or [])
    if source == "release":
        df = spark.read.parquet(*config["paths"])
        rows = resolve_aliases(df.withColumn("target", F.col("target").cast("int"))).withColumn("project", name_of("project"))
        rows = rows.filter(has_text("func")).withColumn("fn_id", F.monotonically_increasing_id())
        return only_projects(first_copies(rows), config.get("projects") or [])
    raise ValueError(f"unknown source {source}")
