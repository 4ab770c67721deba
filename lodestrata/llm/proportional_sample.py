"""A sample whose categories have given shares, with a minimum for small ones.

Method: divisor-method priorities. Every usable row gets a random rank within its category (an md5 of seed and id
orders the rows); its priority is (rank - 0.5) / share, and the rows of a category's minimum come before all others. The
rows of smallest priority are kept. A category that runs out of rows gives no more priorities, so its seats go to the
others by themselves.

The cut through all priorities follows from the categories' row counts alone: category c has
min(n_c, floor(t * share_c + 0.5)) priorities up to t. So no global sort is needed, and only one row for each category
of the target table reaches the driver (at most ``MAX_CATEGORIES``, checked). Ranks of hot categories are made in ranges.

Defined results: rows whose text is null or blank, whose label is null or whose category isn't in the target table are
never drawn; ties of priority go to the smaller (project, target); ties of the hash to the smaller id; repeated rows
count each; an empty table gives an empty sample and reports every category that needs rows.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranking import hash_cell, spread_rank
from lodestrata.session import materialize

MAX_CATEGORIES = 100_000


def clean_project(c: Column) -> Column:
    """Trimmed of white space of any kind, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def seats(categories: list[tuple], total: int) -> list[int]:
    """Seats of categories (share, minimum, rows), in the order of their names, for a sample of ``total`` rows."""
    floor = [min(m, n) for _, m, n in categories]
    if sum(floor) >= total:  # minimum rows come first; among them smaller ranks, then smaller names
        out, r = [0] * len(floor), 1
        left = total
        while left > 0:
            for k, f in enumerate(floor):
                if f >= r and left > 0:
                    out[k] += 1
                    left -= 1
            r += 1
        return out

    def at(t: float) -> list[int]:
        return [max(f, min(n, int(t * s + 0.5))) for f, (s, _, n) in zip(floor, categories, strict=True)]

    lo, hi = 0.0, 2.0 * (max([n for *_, n in categories] or [0]) + 1)
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) <= total else (lo, mid)
    out = at(lo * (1 - 1e-9))
    heap = [(Fraction(2 * out[k] + 1, 2 * s), k) for k, (s, _, n) in enumerate(categories) if s > 0 and out[k] < n]
    heapq.heapify(heap)
    while heap and sum(out) < total:
        _, k = heapq.heappop(heap)
        out[k] += 1
        s, _, n = categories[k]
        if out[k] < n:
            heapq.heappush(heap, (Fraction(2 * out[k] + 1, 2 * s), k))
    return out


def plan_sample(rows: DataFrame, targets: DataFrame, one_in: int = 10, seed: str = "sample") -> tuple[DataFrame, DataFrame, int]:
    """The usable rows of the wanted categories with their ranks (fn_id, project, target, rank), the report per category, and the sample's size.

    Report: (project, target, share_permille, min_rows, usable, needed, seats, met). A category's usable rows are its largest rank.
    Of a category given twice the larger share and minimum hold, null ones are zero; rows without project or target are no category.
    """
    spark = rows.sparkSession
    named = targets.filter(F.col("project").isNotNull() & F.col("target").isNotNull()).groupBy("project", "target")
    wanted = named.agg(*[F.coalesce(F.max(F.greatest(c, F.lit(0))), F.lit(0)).cast("int").alias(c) for c in ("share_permille", "min_rows")]).limit(MAX_CATEGORIES + 1)
    if wanted.count() > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    usable = rows.filter(F.col("func").rlike(r"(?U)\S") & F.col("target").isNotNull()).select("fn_id", clean_project(F.col("project")).alias("project"), "target")
    usable = usable.join(wanted.select("project", "target"), ["project", "target"], "left_semi")
    hashed = usable.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("fn_id").cast("string"))))
    ranked = materialize(spread_rank(hashed, ["project", "target"], ["h", "fn_id"], hash_cell("h")).select("fn_id", "project", "target", F.col("rank").cast("bigint").alias("rank")), "ranked")
    total = rows.count() // one_in
    counted = ranked.groupBy("project", "target").agg(F.max("rank").alias("usable"))
    report = wanted.join(counted, ["project", "target"], "left").fillna(0, ["usable"]).collect()
    report = sorted(report, key=lambda r: (r["project"], r["target"]))
    got = seats([(r["share_permille"], r["min_rows"], r["usable"]) for r in report], total)
    out = []
    for r, s in zip(report, got, strict=True):
        needed = max(-(-r["share_permille"] * total // 1000), r["min_rows"])
        out.append((r["project"], r["target"], r["share_permille"], r["min_rows"], r["usable"], needed, s, r["usable"] >= needed))
    schema = "project string, target int, share_permille int, min_rows int, usable bigint, needed bigint, seats bigint, met boolean"
    return ranked, spark.createDataFrame(out, schema), total


def draw(ranked: DataFrame, report: DataFrame) -> DataFrame:
    """(fn_id, project, target, rank, priority) of the rows of smallest priority; both arguments as of ``plan_sample``."""
    quota = F.broadcast(report.filter("seats > 0").select("project", "target", "share_permille", "min_rows", "seats"))  # at most MAX_CATEGORIES rows
    drawn = ranked.join(quota, ["project", "target"]).filter("rank <= seats")
    priority = F.when(F.col("rank") <= F.col("min_rows"), F.lit(0.0)).otherwise((F.col("rank") - 0.5) / F.col("share_permille"))
    return drawn.select("fn_id", "project", "target", "rank", priority.alias("priority"))
