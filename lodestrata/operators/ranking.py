"""Exact row numbers inside keys of any size.

A plain ``row_number()`` sorts one key in one task. Here the order column is cut into ranges first; ranks inside a
(key, range) cell come from a window, and the number of rows in the ranges before it is added. A key that holds a
third of all rows is thus spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def spread_rank(df: DataFrame, keys: list[str], order: list[str], cell: Column, out: str = "rank", ranges: int = RANGES) -> DataFrame:
    """Add ``out``: the 1-based position of each row among the rows with equal ``keys``, ordered by ``order``.

    ``cell`` must be an INT expression in [0, ranges) that never decreases along ``order`` (for a hash order, its
    leading bits). Null keys form one group, as in GROUP BY. Ties of ``order`` get different ranks. An empty table
    stays empty. The cell counts have at most (distinct keys x ranges) rows.
    """
    c, before = f"__{out}_cell", f"__{out}_before"
    df = df.withColumn(c, cell)
    counts = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(c).alias("__kc"), before)
    cond = F.col(c) == F.col("__kc")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = Window.partitionBy(*keys, c).orderBy(*order)
    ranked = df.withColumn("__in", F.row_number().over(inner)).join(counts, cond)
    return ranked.withColumn(out, F.col("__in") + F.col(before)).drop("__in", before, c, "__kc", *[f"__k{i}" for i in range(len(keys))])


def spread_sums(df: DataFrame, keys: list[str], order: list[str], cell: Column, values: list[str], ranges: int = RANGES) -> DataFrame:
    """Add ``before_<v>`` for each of ``values``: its sum over the rows before each one, among those with equal ``keys`` in ``order``.

    ``cell`` as in ``spread_rank``; the rows of a key are spread over as many tasks as there are cells.
    """
    df = df.withColumn("__cell", cell)
    sums = df.groupBy(*keys, "__cell").agg(*[F.sum(v).alias(v) for v in values])
    w = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__cell").alias("__kc"), *[F.coalesce(F.sum(v).over(w), zero).alias(f"__b_{v}") for v in values])
    cond = F.col("__cell") == F.col("__kc")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.coalesce(F.sum(v).over(inner), zero).alias(f"__i_{v}") for v in values]).join(sums, cond)
    return out.select(*[c for c in df.columns if c != "__cell"], *[(F.col(f"__i_{v}") + F.col(f"__b_{v}")).alias(f"before_{v}") for v in values])


def spread_next(df: DataFrame, keys: list[str], order: str, cell: Column, out: str = "next") -> DataFrame:
    """Add ``out``: the value of ``order`` in the next row among those with equal ``keys``, null for the last; spread like ``spread_sums``."""
    df = df.withColumn("__cell", cell)
    firsts = df.groupBy(*keys, "__cell").agg(F.min(order).alias("__first"))
    firsts = firsts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__cell").alias("__kc"), F.lead("__first").over(Window.partitionBy(*keys).orderBy("__cell")).alias("__then"))
    cond = F.col("__cell") == F.col("__kc")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = Window.partitionBy(*keys, "__cell").orderBy(order)
    joined = df.withColumn("__lead", F.lead(order).over(inner)).join(firsts, cond)
    return joined.select(*[c for c in df.columns if c != "__cell"], F.coalesce("__lead", "__then").alias(out))


def number_cell(value: Column, low: float, high: float, ranges: int = RANGES) -> Column:
    """The cell of a number among ``ranges`` equal ones from ``low`` to ``high``; what lies outside falls into the outermost."""
    width = (high - low) or 1
    at = F.floor((value.cast("double") - F.lit(float(low))) / F.lit(float(width)) * F.lit(ranges))
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(ranges - 1)).cast("int"), F.lit(0))


def hash_cell(hex_hash: str, ranges: int = RANGES) -> Column:
    """Leading 8 bits of a lower-case hexadecimal hash column, as the cell of ``spread_rank``; a null hash comes first."""
    return F.coalesce(F.conv(F.substring(hex_hash, 1, 2), 16, 10).cast("int") % F.lit(ranges), F.lit(0))
