"""Splits that keep related records together.

Method: connected components over records that share an entity (here: a commit named in ``commit_id``), by alternating
large-star and small-star, then a hash of the component's identifier into ranges in the splits' proportions.

The graph holds entities only: a record that names one entity adds no edge, one that names several ties them together,
so an entity with a third of all rows is one node. All steps are joins and grouped minima with written tables between
rounds; nothing is collected but one checksum a round, the few split shares, and one row for each of the ``RANGES`` ranges
of the hash.

Components differ in size, so ranges of equal length hold different numbers of rows. The hash is therefore cut into
``RANGES`` ranges, and each split gets as many of them as fill its share of the rows and of the positive labels: ranges are
dealt out from the fullest to the emptiest, each to the split whose open room has the largest dot product with it. One
rule holds for components of every size.

Defined results: a null or blank value, or one without a run of 12 to 40 hexadecimal digits, names nothing, and its
record is a group of its own (records with a null id together form one). A shorter run names the one known 40-digit commit that starts with it; if none or
several do, it names nothing. Repeated rows change nothing; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialize

#: Ranges of the hash of a component; one row each reaches the driver.
RANGES = 4096
#: More splits than these are an error.
MAX_SPLITS = 1000
MAX_ROUNDS = 60


def named_commits(df: DataFrame, id_col: str = "fn_id", text_col: str = "commit_id") -> DataFrame:
    """(id, entity): each 40-digit commit a record names, by itself or by a shorter start of it."""
    runs = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit("[0-9a-f]+"), F.lit(0)), lambda x: F.length(x).between(12, 40))
    named = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array_distinct(runs)).alias("name"))
    full = named.filter(F.length("name") == 40)
    short = named.filter(F.length("name") < 40)
    known = full.select(F.col("name").alias("entity")).distinct().withColumn("start", F.substring("entity", 1, 12))
    match = short.select("name").distinct().withColumn("start", F.substring("name", 1, 12)).join(known, "start").filter(F.col("entity").startswith(F.col("name")))
    one = match.groupBy("name").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("name", "entity")
    return full.select("id", F.col("name").alias("entity")).unionByName(short.join(one, "name").select("id", "entity")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b); roots themselves aren't listed.

    Rounds of large-star then small-star until the edges no longer change.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    print_of = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(e)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct(), "edges")
        now = print_of(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components haven't settled after {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def entity_groups(links: DataFrame) -> DataFrame:
    """(id, group_key) of records that name entities: ``links`` is (id, entity); the key is the smallest entity of the group."""
    links = materialize(links, "links")
    least = links.groupBy("id").agg(F.min("entity").alias("first"), F.max("entity").alias("last"))
    several = least.filter("first <> last").select("id", "first")
    edges = links.join(several, "id").filter("entity <> first").select(F.col("first").alias("a"), F.col("entity").alias("b"))
    roots = components(edges)
    return least.select("id", F.col("first").alias("node")).join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("group_key"))


def tied_records(groups: DataFrame) -> DataFrame:
    """Rows of (id, group_key) whose group has at least two records."""
    several = groups.groupBy("group_key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("group_key")
    return groups.join(several, "group_key").select("id", "group_key")


def deal_ranges(ranges: list[tuple[int, int, int]], shares: list[tuple[str, int]]) -> list[tuple[int, str]]:
    """(range, split) for ranges (number, rows, positives), so that splits hold rows and positives in proportion to their shares."""
    rows, positive = sum(n for _, n, _ in ranges) or 1, sum(p for *_, p in ranges) or 1
    weight = sum(w for _, w in shares) or 1
    room = {s: [w / weight, w / weight] for s, w in shares}  # in parts of all rows and of all positives
    out = []
    for k, n, p in sorted(ranges, key=lambda r: (-r[1], -r[2], r[0])):
        n, p = n / rows, p / positive
        best = max(room, key=lambda s: (n * room[s][0] + p * room[s][1], s))
        room[best][0] -= n
        room[best][1] -= p
        out.append((k, best))
    return out


def assign_splits(df: DataFrame, groups: DataFrame, targets: DataFrame, id_col: str = "fn_id", label_col: str = "target") -> DataFrame:
    """(id, group_key, split, label) for every row; records without entity have the key 'fn:<id>'.

    A split given twice has its larger share, a null share is none, a null split is left out. Raises an error where
    ``targets`` has no split or more than ``MAX_SPLITS``.
    """
    one = targets.filter(F.col("split").isNotNull()).groupBy("split").agg(F.coalesce(F.max("share_permille"), F.lit(0)).alias("share"))
    shares = sorted((r["split"], r["share"]) for r in one.limit(MAX_SPLITS + 1).collect())
    if not 0 < len(shares) <= MAX_SPLITS:
        raise ValueError(f"1 to {MAX_SPLITS} splits, not {len(shares)} or more")
    keyed = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).join(groups, "id", "left")
    keyed = keyed.withColumn("group_key", F.coalesce("group_key", F.concat(F.lit("fn:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    cell = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("split:"), F.col("group_key"))), 1, 12), 16, 10).cast("bigint"), F.lit(RANGES)).cast("int")
    keyed = materialize(keyed.withColumn("cell", cell), "keyed")
    positive = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    ranges = [tuple(r) for r in keyed.groupBy("cell").agg(F.count(F.lit(1)), positive).collect()]  # at most RANGES rows
    dealt = df.sparkSession.createDataFrame(deal_ranges(ranges, shares), "cell int, split string")
    return keyed.join(F.broadcast(dealt), "cell").select("id", "group_key", "split", "label")
