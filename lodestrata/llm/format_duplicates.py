"""Duplicates hidden by formatting: records that are equal but for letter case, punctuation and white space.

Method: recursive radix partitioning on canonical bytes. Each record becomes its label, a zero byte and the letters
and digits of its text in lower case. Buckets are prefixes of these bytes; a bucket that is larger than ``bucket_bytes``
is split by further bytes, again and again, until each fits. Inside a bucket a trie with terminal counters counts the
copies. Records that are equal throughout can't be told apart by further bytes: they are pre-aggregated within every
batch before the first shuffle, and a bucket of one single string is counted in salted parts which are then added up.

Defined results: no text, no letter or digit in it, or no label -> not a record here, and in no result. Ties: the kept
record is that of the smallest id. Repeated ids count as copies and are given once. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialize, ship_package, spread

#: Bytes of one bucket's distinct strings that a task holds as a trie.
BUCKET_BYTES = 8 << 20
FIRST_BYTES = 6
SALTS = 16


def canonical(text: Column, label: Column) -> Column:
    """The bytes that two equal records share; null where the record doesn't count."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "")
    return F.when(label.isNotNull() & (letters != ""), F.encode(F.concat(label, F.lit("\0"), letters), "utf-8"))


def label_text(value) -> str | None:
    """One spelling for each meaning of a label: numbers without needless digits, booleans as 0 and 1."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, str):
        word = value.strip().lower()
        if word in ("true", "false"):
            return "1" if word == "true" else "0"
        try:
            value = float(word)
        except ValueError:
            return word or None
    if isinstance(value, (int, float)):
        if value != value or value in (float("inf"), float("-inf")):
            return None
        return str(int(value)) if value == int(value) else repr(float(value))
    return json.dumps(value, sort_keys=True)


def parse_payloads(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, func, label) of JSON payloads by the loader's keys; rows whose payload isn't one valid JSON object are left out."""
    ship_package(df.sparkSession)

    def first(record: dict, *names: str):
        return next((record[k] for k in names if record.get(k) is not None and record[k] != ""), None)

    def parse(payload: str | None) -> tuple[str | None, str | None]:
        try:
            record = json.loads(payload) if payload is not None else None
        except ValueError:
            return None, None
        if not isinstance(record, dict):
            return None, None
        func = first(record, "func", "function", "code")
        return (func if isinstance(func, str) else None), label_text(first(record, "target", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(p) for p in batch.column(1).to_pylist()]
            # a lone half of a surrogate pair can't be stored as text
            funcs = [f if f is None else f.encode("utf-8", "replace").decode("utf-8") for f, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(funcs, pa.string()), pa.array([b for _, b in got], pa.string())], names=["id", "func", "label"])

    return df.select(F.col(id_col).cast("bigint"), payload_col).mapInArrow(run, "id bigint, func string, label string")


def combine_batches(records: DataFrame) -> DataFrame:
    """(origin, canon, digest, n, ids): equal strings of one batch as one row. A hot string thus leaves a map task once per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = b.groupby(["origin", "canon", "digest"], sort=False)["id"].agg(list).reset_index(name="ids")
            yield got[["origin", "canon", "digest", "ids"]]

    return records.mapInPandas(run, "origin string, canon binary, digest binary, ids array<bigint>")


class Trie:
    """Byte trie with edges of several bytes; each terminal holds [copies, smallest id, digest]."""

    def __init__(self):
        self.root: dict = {}
        self.terminals: list[list] = []

    def add(self, key: bytes, n: int, smallest: int, digest: bytes) -> None:
        node, i, size = self.root, 0, len(key)
        while True:
            # a node maps the next byte to [edge, node below, terminal or None]
            edge = node.get(key[i])
            if edge is None:
                node[key[i]] = [key[i:], {}, self._terminal(n, smallest, digest)]
                return
            label = edge[0]
            if key.startswith(label, i):
                i += len(label)
                if i == size:
                    if edge[2] is None:
                        edge[2] = self._terminal(n, smallest, digest)
                    else:
                        edge[2][0] += n
                        edge[2][1] = min(edge[2][1], smallest)
                    return
                node = edge[1]
                continue
            lo, hi = 0, min(len(label), size - i)
            while lo < hi:  # longest common part of the edge and the key
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if key.startswith(label[:mid], i) else (lo, mid - 1)
            below = {label[lo]: [label[lo:], edge[1], edge[2]]}
            node[key[i]] = upper = [label[:lo], below, None]
            i += lo
            if i == size:
                upper[2] = self._terminal(n, smallest, digest)
            else:
                below[key[i]] = [key[i:], {}, self._terminal(n, smallest, digest)]
            return

    def _terminal(self, n: int, smallest: int, digest: bytes) -> list:
        self.terminals.append([n, smallest, digest])
        return self.terminals[-1]


def radix_buckets(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """Add ``bucket`` (a prefix of ``canon``; null for a bucket that is one single string too large for one bucket).

    Each round counts only the rows of buckets that were too large in the round before. The lists of split prefixes
    have at most total bytes / bucket_bytes rows each; they are written tables, so Spark broadcasts them only below its size limit.
    """
    prefix = lambda depth: F.substring("canon", 1, depth)
    weight = F.sum(F.length("canon") + F.lit(64))
    pending, splits, depth = rows.select("origin", "canon"), [], first_bytes
    while True:
        counted = pending.groupBy("origin", prefix(depth).alias("p")).agg(weight.alias("bytes"), F.max(F.length("canon")).alias("longest"))
        large = materialize(counted.filter(F.col("bytes") > bucket_bytes).select("origin", "p", (F.col("longest") <= depth).alias("single")), "radix")
        kinds = {r["single"] for r in large.select("single").distinct().collect()}
        if kinds:
            splits.append((depth, large))
        if False not in kinds:
            break
        more = large.filter(~F.col("single")).select("origin", "p")
        pending = pending.withColumn("p", prefix(depth)).join(more, ["origin", "p"], "left_semi").drop("p")
        depth *= 2
    out = rows.withColumn("bucket", prefix(first_bytes)).withColumn("open", F.lit(True)).withColumn("single", F.lit(False))
    for k, (depth, large) in enumerate(splits):
        out = out.withColumn("p", prefix(depth)).join(large.withColumnRenamed("single", "now"), ["origin", "p"], "left")
        further = F.col("open") & (F.col("now") == F.lit(False))
        out = out.withColumn("bucket", F.when(F.coalesce(further, F.lit(False)), prefix(depth * 2)).otherwise(F.col("bucket")))
        out = out.withColumn("single", F.col("single") | F.coalesce(F.col("open") & F.col("now"), F.lit(False))).withColumn("open", F.coalesce(further, F.lit(False))).drop("p", "now")
    return out.withColumn("bucket", F.when(~F.col("single"), F.col("bucket"))).drop("open", "single")


def count_in_tries(bucketed: DataFrame) -> DataFrame:
    """(origin, digest, keep_id, copies) of every distinct string, by one trie per bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(at: tuple, trie: Trie) -> pd.DataFrame:
            t = trie.terminals
            return pd.DataFrame({"origin": at[0], "single": at[1] is None, "digest": [x[2] for x in t], "keep_id": [x[1] for x in t], "copies": [x[0] for x in t]})

        at, trie = None, None
        for b in batches:
            for origin, bucket, salt, canon, digest, n, smallest in zip(b["origin"], b["bucket"], b["salt"], b["canon"], b["digest"], b["n"], b["smallest"], strict=True):
                key = (origin, bucket, salt)
                if key != at:
                    if trie:
                        yield out(at, trie)
                    at, trie = key, Trie()
                trie.add(canon, n, smallest, digest)
        if trie:
            yield out(at, trie)

    salt = F.when(F.col("bucket").isNull(), F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(SALTS))).otherwise(F.lit(0))
    rows = bucketed.withColumn("salt", salt.cast("int")).select("origin", "bucket", "salt", "canon", "digest", F.size("ids").alias("n"), F.array_min("ids").alias("smallest"))
    placed = rows.repartition("origin", "bucket", "salt").sortWithinPartitions("origin", "bucket", "salt")
    counted = placed.mapInPandas(run, "origin string, single boolean, digest binary, keep_id bigint, copies bigint")
    parts = counted.filter("single").groupBy("origin", "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    return counted.filter("NOT single").select("origin", "digest", "keep_id", "copies").unionByName(parts)


def format_groups(records: DataFrame, bucket_bytes: int = BUCKET_BYTES, first_bytes: int = FIRST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of records (origin STRING, id BIGINT, func STRING, label STRING): the counted groups and the written members.

    Groups: (origin, digest, keep_id, copies), one row for each distinct record. Members: (origin, canon, digest, ids).
    """
    ship_package(records.sparkSession)
    keyed = spread(records).select("origin", "id", canonical(F.col("func"), F.col("label")).alias("canon")).filter(F.col("canon").isNotNull() & F.col("id").isNotNull())
    keyed = keyed.withColumn("digest", F.unhex(F.substring(F.sha2("canon", 256), 1, 32)))
    members = materialize(combine_batches(keyed), "canon")
    groups = materialize(count_in_tries(radix_buckets(members, bucket_bytes, first_bytes)), "copies")
    return groups, members


def duplicate_rows(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(origin, keep_id, dup_id) for each member of a group but the kept one. The digest join carries ids only, never texts."""
    several = groups.filter("copies > 1").select("origin", "digest", "keep_id")
    rows = members.select("origin", "digest", "ids").join(several, ["origin", "digest"])
    return rows.select("origin", "keep_id", F.explode(F.array_distinct("ids")).alias("dup_id")).filter("dup_id <> keep_id").distinct()


def function_records(raw_functions: DataFrame) -> DataFrame:
    return raw_functions.select(F.lit("raw_functions").alias("origin"), F.col("fn_id").cast("bigint").alias("id"), "func", F.col("target").cast("string").alias("label"))


def payload_records(raw_records: DataFrame) -> DataFrame:
    return parse_payloads(raw_records, "record_id", "payload").select(F.lit("raw_records").alias("origin"), "id", "func", "label")
