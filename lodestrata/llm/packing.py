"""Filling containers of fixed capacity with items of varying length.

Method: vector bin packing by the dot-product heuristic, under limits on tokens (nodes), number of segments and
loss-bearing tokens. Items of the same vector are interchangeable, so the heuristic works on classes, of which there
are at most 2 x capacity however many items exist. It fills one container at a time with the class whose vector has the
largest weighted dot product with the room left, and repeats the filled container as often as its classes last; each
such pattern uses up a class, so there are at most as many patterns as classes. The plan is thus bounded by the
capacity and is made in one task per budget; items find their container from their rank within their class, by binary
search, without any item passing through the driver or gathering in one task.

Defined results: rows of one id are one item (the largest length counts); null, zero or negative lengths, null ids ->
no item; an item is split only if it is longer than one container may hold, into full pieces and a rest. Only items
with a label bear loss; one that bears more than ``max_loss`` by itself isn't split for that but is the only one in its
container that bears loss. Ties between classes: the longer one, then the one that bears loss. Budgets without a name or a positive
capacity are none, one given twice has its smaller capacity. An empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranking import hash_cell, spread_rank
from lodestrata.session import materialize, ship_package

MAX_BUDGETS = 1000
#: The capacity bounds the plan; larger ones would let the plan grow beyond what one task should hold.
MAX_CAPACITY = 200_000


def plan_patterns(size: np.ndarray, loss: np.ndarray, count: np.ndarray, limits: tuple[int, int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(class, copies)]) that use up every class. Each class must fit into an empty container.

    Among classes that bear loss, and among those that don't, a longer one has the larger dot product with any room left. So
    each choice is between the longest of either kind that fits, which is found in the order of lengths, where used-up
    classes are skipped over: the work grows with the items of the patterns, not with the classes looked at.
    """
    cap, max_segments, max_loss = limits
    # an item that bears more loss than a container may hold takes up all of that limit
    bears = np.minimum(size, max_loss) * loss
    vec = np.stack([size, np.ones_like(size), bears], axis=1).astype(np.float64) / np.array(limits, np.float64)
    weight = (vec * count[:, None]).sum(axis=0)
    w = (weight / max(weight.max(), 1e-12) / np.array(limits, np.float64) ** 2).tolist()
    left = [int(n) for n in count]
    kinds = []  # for each kind: its classes by length, their lengths, and where to look on below each one
    for k in (0, 1):
        own = np.flatnonzero((loss == k) & (count > 0))
        own = own[np.argsort(size[own], kind="stable")]
        kinds.append((own.tolist(), size[own].tolist(), list(range(len(own)))))

    def longest(kind: int, limit: int) -> int:
        """Place of the longest class of a kind, of at most ``limit``, that isn't used up; -1 if there is none."""
        _, lengths, below = kinds[kind]
        k = bisect_right(lengths, limit) - 1
        path = []
        while k >= 0 and below[k] != k:
            path.append(k)
            k = below[k]
        for p in path:
            below[p] = k
        return k

    out, todo = [], sum(1 for n in left if n)
    while todo:
        nodes, segments, room = cap, max_segments, max_loss
        used: dict[int, int] = {}
        while segments:
            choices = []
            for kind, limit in ((0, nodes), (1, nodes if room == max_loss else min(nodes, room))):
                k = longest(kind, limit)
                if k >= 0:
                    classes, lengths, _ = kinds[kind]
                    n, b = lengths[k], min(lengths[k], max_loss) * kind
                    choices.append((w[0] * nodes * n + w[1] * segments + w[2] * room * b, n, kind, k, b, classes[k]))
            if not choices:
                break
            _, n, kind, k, b, c = max(choices)
            nodes, segments, room = nodes - n, segments - 1, room - b
            used[c] = used.get(c, 0) + 1
            if used[c] == left[c]:  # used up by this container, which is thus filled once
                kinds[kind][2][k] = k - 1
                todo -= 1
        times = min(left[c] // n for c, n in used.items())
        for c, n in used.items():
            left[c] -= n * times
            if not left[c] and times > 1:  # used up by the repetitions
                kind = int(loss[c])
                k = bisect_left(kinds[kind][1], int(size[c]))
                kinds[kind][2][k] = k - 1
                todo -= 1
        out.append((times, list(used.items())))
    return out


def items_of(graphs: DataFrame, id_col: str, size_col: str, label_col: str) -> DataFrame:
    """(id, size, loss): one row per item."""
    one = graphs.filter(F.col(id_col).isNotNull() & (F.col(size_col) > 0)).groupBy(F.col(id_col).cast("bigint").alias("id"))
    return one.agg(F.max(size_col).cast("bigint").alias("size"), F.max(F.col(label_col).isNotNull().cast("int")).alias("loss"))


def pack(items: DataFrame, budgets: DataFrame, max_segments: int | None = None, max_loss: int | None = None, loss_permille: int | None = None) -> DataFrame:
    """(budget_name, container_id, id, piece, nodes): where every piece of every item lies, for each budget.

    ``budgets``: (budget_name, max_nodes), at most ``MAX_BUDGETS`` rows. ``max_segments`` and ``max_loss`` default to
    the capacity, where they never bind; ``loss_permille`` sets ``max_loss`` as a part of each budget's capacity.
    """
    spark = items.sparkSession
    ship_package(spark)
    named = budgets.filter(F.col("budget_name").isNotNull() & (F.col("max_nodes") > 0)).groupBy("budget_name").agg(F.min("max_nodes").cast("bigint").alias("max_nodes"))
    rows = named.limit(MAX_BUDGETS + 1).collect()
    if len(rows) > MAX_BUDGETS or any(r[1] > MAX_CAPACITY for r in rows):
        raise ValueError(f"at most {MAX_BUDGETS} budgets of at most {MAX_CAPACITY}")
    limits = {r[0]: (r[1], max_segments or r[1], max_loss or (max(1, r[1] * loss_permille // 1000) if loss_permille else r[1])) for r in rows}
    cells = [F.struct(F.lit(b).alias("budget_name"), F.lit(lim[0]).cast("bigint").alias("cap")) for b, lim in limits.items()]
    if not cells:
        return spark.createDataFrame([], "budget_name string, container_id bigint, id bigint, piece int, nodes bigint")
    pieces = items.withColumn("b", F.explode(F.array(*cells))).withColumn("unit", F.col("b.cap"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / F.col("unit")).cast("int"))))
    pieces = pieces.select(F.col("b.budget_name").alias("budget_name"), "id", "piece", F.least("unit", F.col("size") - F.col("piece") * F.col("unit")).alias("nodes"), "loss")
    pieces = materialize(pieces, "pieces")
    classes = pieces.groupBy("budget_name", "nodes", "loss").agg(F.count(F.lit(1)).alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["nodes", "loss"]).reset_index(drop=True)
        name = pdf["budget_name"][0]
        used, base, out = np.zeros(len(pdf), np.int64), 0, []
        for times, content in plan_patterns(pdf["nodes"].to_numpy(), pdf["loss"].to_numpy(), pdf["n"].to_numpy(), limits[name]):
            for k, n in content:
                out.append((name, pdf["nodes"][k], pdf["loss"][k], used[k], n, base))
                used[k] += n * times
            base += times
        return pd.DataFrame(out, columns=["budget_name", "nodes", "loss", "first_rank", "each", "first_container"])

    planned = classes.groupBy("budget_name").applyInPandas(plan, "budget_name string, nodes bigint, loss int, first_rank bigint, each bigint, first_container bigint")
    # bounded by the budgets' capacities, not by the number of items
    plan_rows = planned.toPandas()
    places = {key: (g["first_rank"].to_numpy(), g["each"].to_numpy(), g["first_container"].to_numpy()) for key, g in plan_rows.sort_values("first_rank").groupby(["budget_name", "nodes", "loss"])}
    sent = spark.sparkContext.broadcast(places)

    hashed = pieces.withColumn("h", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("piece").cast("string"))))
    ranked = spread_rank(hashed, ["budget_name", "nodes", "loss"], ["h", "id", "piece"], hash_cell("h"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = np.empty(len(b), np.int64)
            for key, g in b.groupby(["budget_name", "nodes", "loss"], sort=False):
                first, each, base = sent.value[key]
                r = g["rank"].to_numpy() - 1
                k = np.searchsorted(first, r, side="right") - 1
                where[b.index.get_indexer(g.index)] = base[k] + (r - first[k]) // each[k]
            yield pd.DataFrame({"budget_name": b["budget_name"], "container_id": where, "id": b["id"], "piece": b["piece"], "nodes": b["nodes"]})

    return ranked.select("budget_name", "nodes", "loss", "rank", "id", "piece").mapInPandas(place, "budget_name string, container_id bigint, id bigint, piece int, nodes bigint")


def split_items(placed: DataFrame) -> DataFrame:
    """(budget_name, id) of the items that were split."""
    return placed.filter("piece = 1").select("budget_name", "id").distinct()


def fill_report(placed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, containers, items, nodes, unused_permille): how well each budget's containers are filled."""
    one = placed.groupBy("budget_name", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("nodes").alias("nodes"))
    total = one.groupBy("budget_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("nodes").alias("nodes"))
    room = F.col("containers") * F.col("max_nodes")
    caps = budgets.groupBy("budget_name").agg(F.min(F.when(F.col("max_nodes") > 0, F.col("max_nodes"))).alias("max_nodes"))
    return total.join(caps, "budget_name").select("budget_name", "containers", "items", "nodes", ((room - F.col("nodes")) * 1000 / room).alias("unused_permille"))


def limit_report(placed: DataFrame, items: DataFrame) -> DataFrame:
    """(budget_name, containers, most_segments, most_loss, single_loss): the fullest container by each limit; ``single_loss`` counts those with one loss-bearing item only."""
    bears = items.select("id", "loss")
    one = placed.join(bears, "id").groupBy("budget_name", "container_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("nodes") * F.col("loss")).alias("loss"), F.sum("loss").alias("bearing"))
    return one.groupBy("budget_name").agg(F.count(F.lit(1)).alias("containers"), F.max("segments").alias("most_segments"), F.max(F.when(F.col("bearing") > 1, F.col("loss"))).alias("most_loss"), F.count_if(F.col("bearing") == 1).alias("single_loss"))
