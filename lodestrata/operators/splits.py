"""Splits and resampling by seeded hash order: stratified, group-disjoint, imbalanced, unseen-group holdout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.texts import stripped
from lodestrata.operators.ranking import hash_cell, spread_rank
from lodestrata.session import materialize, ship_package


def shuffled(df: DataFrame, id_col: str, seed: str) -> DataFrame:
    """Add ``__h``: a hash that orders rows as if shuffled with ``seed``; the same in every run and engine."""
    return df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))


def ranked_in(df: DataFrame, keys: list[str], id_col: str, seed: str, out: str = "rank") -> DataFrame:
    return spread_rank(shuffled(df, id_col, seed), keys, ["__h", id_col], hash_cell("__h"), out).drop("__h")


def stratified(df: DataFrame, label_col: str, id_col: str, train: float = 0.75, val: float = 0.125, seed: str = "stratified") -> DataFrame:
    """Add ``part``: of each class, the first floor(n * train) rows in hash order are train, the next floor(n * val) val, the rest test.

    Rows without a label take no part.
    """
    rows = df.filter(F.col(label_col).isNotNull())
    sizes = rows.groupBy(F.col(label_col).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    r = ranked_in(rows, [label_col], id_col, seed, "__r").join(sizes, F.col(label_col) == F.col("__c"))
    n_train, n_val = F.floor(F.col("__n") * train), F.floor(F.col("__n") * val)
    part = F.when(F.col("__r") <= n_train, "train").when(F.col("__r") <= n_train + n_val, "val").otherwise("test")
    return r.withColumn("part", part).drop("__r", "__n", "__c")


def stratified_pair(df: DataFrame, label_col: str, id_col: str, train: float = 0.75, seed: str = "stratified") -> DataFrame:
    """Add ``part``: of each class the first floor(n * train) rows in hash order are train, all others val.

    What rounding leaves over goes to val, so that no part is needed besides the two.
    """
    return stratified(df, label_col, id_col, train, 1 - train, seed).withColumn("part", F.when(F.col("part") == "train", "train").otherwise("val"))


def split_rows(df: DataFrame, config: dict, label_col: str = "target", group_col: str = "commit_id", id_col: str = "fn_id") -> DataFrame:
    """Add ``part`` as ``config`` says (E4): ``split_by`` 'commit' keeps groups together, 'random' (the default) is stratified by label;
    with ``paper_split`` there is no test part and val has all that isn't train."""
    train, val, paper = config.get("train_split", 0.75), config.get("val_split", 0.125), bool(config.get("paper_split"))
    by = config.get("split_by") or "random"
    if by == "commit":
        out = group_disjoint(df, group_col, id_col, train, 1 - train if paper else val)
        return out.withColumn("part", F.when(F.col("part") == "train", "train").otherwise("val")) if paper else out
    if by != "random":
        raise ValueError(f"unknown way to split: {by}")
    return stratified_pair(df, label_col, id_col, train) if paper else stratified(df, label_col, id_col, train, val)


def group_disjoint(df: DataFrame, group_col: str, id_col: str, train: float = 0.75, val: float = 0.125, seed: str = "group") -> DataFrame:
    """Add ``part`` so that no group spans two parts: groups in hash order fill train, then val, then test.

    A group goes to train while the rows before it are fewer than floor(N * train). Rows with a blank or null group are
    groups of their own. The running sum over groups is cut into ranges of the hash, so no task sees all groups.
    """
    blank = F.col(group_col).isNull() | (F.col(group_col) == "")
    rows = df.withColumn("__g", F.when(blank, F.concat(F.lit("row:"), F.col(id_col).cast("string"))).otherwise(F.concat(F.lit("grp:"), F.col(group_col))))
    groups = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("__g"))))
    groups = materialize(groups.withColumn("__cell", hash_cell("__h")), "groups")
    cells = groups.groupBy("__cell").agg(F.sum("__n").alias("__cn"))  # at most 256 rows
    before = F.coalesce(F.sum("__cn").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("__cell", before.alias("__before"), F.sum("__cn").over(Window.partitionBy()).alias("__total"))
    inner = Window.partitionBy("__cell").orderBy("__h", "__g").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(F.broadcast(cells), "__cell")
    placed = placed.withColumn("__cum", F.col("__in") + F.col("__before")).withColumn("__t", F.floor(F.col("__total") * train)).withColumn("__v", F.floor(F.col("__total") * val))
    in_train = F.col("__cum") < F.col("__t")
    train_rows = placed.agg(F.coalesce(F.sum(F.when(in_train, F.col("__n"))), F.lit(0)).alias("__trained"))
    placed = placed.join(F.broadcast(train_rows))  # one row
    part = F.when(in_train, "train").when(F.col("__cum") - F.col("__trained") < F.col("__v"), "val").otherwise("test")
    return rows.join(placed.select("__g", part.alias("part")), "__g").drop("__g")


def imbalance(df: DataFrame, label_col: str, id_col: str, positive_share: float, seed: str = "imbalance") -> DataFrame:
    """All negatives, and in hash order as many positives as make ``positive_share`` of the result (half to even), or all there are."""
    safe = df.filter(F.col(label_col) != 1)
    wanted = safe.agg(F.bround(F.count(F.lit(1)) * F.lit(positive_share) / F.lit(1 - positive_share)).alias("__want"))
    pos = ranked_in(df.filter(F.col(label_col) == 1), [label_col], id_col, seed, "__r").join(F.broadcast(wanted)).filter("__r <= __want")  # one row
    return safe.unionByName(pos.select(*safe.columns))


def unseen_group_holdout(rows: DataFrame, split_col: str, label_col: str, group_col: str, strata_col: str, id_col: str, per_stratum: int = 56, seed: str = "holdout") -> DataFrame:
    """Positives of the test split whose group has no row in train, the first ``per_stratum`` of each stratum in hash order.

    Where there is no test split at all, those of val.
    """
    held = rows.agg(F.coalesce(F.max(F.when(F.col(split_col) == "test", "test")), F.lit("val")).alias("__held"))  # one row
    named = rows.filter(F.col(group_col).isNotNull() & (stripped(group_col) != ""))
    seen = named.filter(F.col(split_col) == "train").select(group_col).distinct()
    pool = named.filter(F.col(split_col).isin("val", "test") & (F.col(label_col) == 1)).join(F.broadcast(held), F.col(split_col) == F.col("__held")).drop("__held")
    pool = pool.join(seen, group_col, "left_anti")
    return ranked_in(pool, [strata_col], id_col, seed, "__r").filter(F.col("__r") <= per_stratum).drop("__r")


def cut_batches(sizes: list[tuple[int, int]], batch_size: int, max_nodes: int) -> list[tuple[int, int, int, int, int]]:
    """Where batches of a row after another begin, for (size, rows) in ascending order: (size, open batch, rows that fit into it, first batch of its own, rows in each of those).

    A batch is closed when one more row would make it more than ``batch_size`` rows, or count * largest size more than
    ``max_nodes``; a row larger than that stands alone.
    """
    out, batch, held = [], 0, 0  # rows in the open batch
    for size, rows in sizes:
        each = max(1, min(batch_size, max_nodes // size))
        fit = min(rows, max(0, min(batch_size, max_nodes // size) - held)) if held else 0
        first = batch + (1 if held else 0)
        out.append((size, batch, fit, first, each))
        left = rows - fit
        if left:
            batch = first + (left - 1) // each
            held = (left - 1) % each + 1
        else:
            held += fit
    return out


def size_batches(df: DataFrame, id_col: str, size_col: str, batch_size: int, max_nodes: int, seed: str = "batches") -> DataFrame:
    """(id, batch_id, size): rows in the order of their size, those of equal size in hash order, cut into batches.

    The cuts are those of one pass over all rows in order (``cut_batches``), which depends on the number of rows of each
    size alone; so it runs over one row for each distinct size, and rows find their batch from their rank within their size.
    Null, zero and negative sizes take no part.
    """
    ship_package(df.sparkSession)
    rows = df.filter(F.col(size_col) > 0).select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        cuts = cut_batches(list(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), batch_size, max_nodes)
        return pd.DataFrame(cuts, columns=["s", "open", "fit", "first", "each"])

    # as many rows as there are different sizes
    counts = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(cut, "s bigint, open bigint, fit bigint, first bigint, each bigint")
    ranked = ranked_in(rows, ["size"], "id", seed, "r").join(counts, F.col("size") == F.col("s"))
    batch = F.when(F.col("r") <= F.col("fit"), F.col("open")).otherwise(F.col("first") + F.expr("(r - fit - 1) div each"))
    return ranked.select("id", batch.alias("batch_id"), "size")
