"""Convolutional readout of a graph's nodes: two branches, a product and a mean give the logit.

A convolution along the nodes is an expression over the neighbouring rows of one window, a pooling is a maximum over
the rows that follow, and the readout over nodes is a grouped maximum; all three need the same partitioning by
function. Weights are literals, so everything stays in JVM expressions; they are meant for vectors of some dozen numbers.

Every value after the first layer is non-negative, and poolings that are followed by the maximum over all nodes can't
change it; so the second pooling along nodes needs no rows of its own.

Defined results: a function without nodes has no row; neighbours beyond the first and the last node count as zeros;
graphs of fewer than four nodes are read as if filled up with absent nodes; a null vector counts as zeros.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_NODES = 4


def dense(inputs: list[Column], weights: np.ndarray, bias: np.ndarray, relu: bool = True) -> list[Column]:
    """W x + b for ``weights`` of shape (out, in), as expressions."""
    out = []
    for row, b in zip(weights, bias, strict=True):
        value = F.lit(float(b))
        for x, w in zip(inputs, row, strict=True):
            value = value + x * float(w)
        out.append(F.greatest(value, F.lit(0.0)) if relu else value)
    return out


def branch_weights(width: int, channels: int, rng: np.random.Generator, axis: str = "nodes") -> dict:
    """Random weights of one branch; ``first`` is (channels, 3 x inputs of one place), ``second`` (channels, channels)."""
    inputs = 3 * (width if axis == "nodes" else 1)
    draw = lambda *shape: np.round(rng.normal(0, 1 / np.sqrt(shape[-1]), shape), 4)
    return {"first": draw(channels, inputs), "b1": draw(channels) * 0.1, "second": draw(channels, channels), "b2": draw(channels) * 0.1}


def conv_over_nodes(states: DataFrame, width: int, w: dict) -> DataFrame:
    """(fn_id, z): the largest response of each filter that slides over the nodes in pre-order; ``states`` is (fn_id, node_id, v)."""
    by = Window.partitionBy("fn_id").orderBy("node_id")
    zeros = F.array(*[F.lit(0.0)] * width)
    rows = states.withColumn("v", F.coalesce("v", zeros))
    near = rows.select(
        "fn_id", "node_id", (F.row_number().over(by) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("fn_id")).alias("n"),
        F.lag("v", 1).over(by).alias("before"), "v", F.lead("v", 1).over(by).alias("after"),
    )
    inputs = [F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) for c in ("before", "v", "after") for k in range(width)]
    channels = len(w["b1"])
    first = near.select("fn_id", "node_id", "place", "n", *[c.alias(f"a{k}") for k, c in enumerate(dense(inputs, w["first"], w["b1"]))])
    three = by.rowsBetween(0, 2)
    pooled = first.select("fn_id", "place", "n", *[F.max(f"a{k}").over(three).alias(f"a{k}") for k in range(channels)])
    # every second place, as long as the window of three reaches past the one before
    pooled = pooled.filter((F.col("place") % 2 == 0) & (F.col("place") + 1 < F.greatest("n", F.lit(MIN_NODES))))
    second = dense([F.col(f"a{k}") for k in range(channels)], w["second"], w["b2"])
    return pooled.groupBy("fn_id").agg(F.array(*[F.max(c) for c in second]).alias("z"))


def conv_over_features(states: DataFrame, width: int, w: dict) -> DataFrame:
    """(fn_id, z): filters that slide over each node's vector instead; the largest response over all nodes at each place left."""
    if width < 3:
        raise ValueError("vectors of at least three numbers")
    x = [F.coalesce(F.get("v", F.lit(k)), F.lit(0.0)) for k in range(width)]
    padded = [F.lit(0.0), *x, F.lit(0.0)]
    first = [dense(padded[j : j + 3], w["first"], w["b1"]) for j in range(width)]
    channels = len(w["b1"])
    flat = states.select("fn_id", *[c.alias(f"a{j}_{k}") for j, place in enumerate(first) for k, c in enumerate(place)])
    starts = range(0, 2 * -(-(width - 3) // 2) + 1, 2)
    pooled = [[F.greatest(*[F.col(f"a{j}_{k}") for j in range(s, min(s + 3, width))]) if s + 1 < width else F.col(f"a{s}_{k}") for k in range(channels)] for s in starts]
    second = [dense(p, w["second"], w["b2"]) for p in pooled]
    # pairs of places; both poolings along nodes end in the maximum over nodes
    out = [F.max(F.greatest(*[second[j][k] for j in (s, s + 1)]) if s + 1 < len(second) else second[s][k]) for k in range(channels) for s in range(0, len(second), 2)]
    return flat.groupBy("fn_id").agg(F.array(*out).alias("z"))


def readout_weights(state: int, init: int, channels: int = 3, hidden: int = 4, out: int = 2, seed: int = 5, axis: str = "nodes") -> dict:
    """Random weights of both branches and their perceptrons, for states of ``state`` and first vectors of ``init`` numbers."""
    rng = np.random.default_rng(seed)
    parts = {}
    for name, width in (("both", state + init), ("last", state)):
        flat = channels if axis == "nodes" else channels * -(-(-(-(width - 3) // 2) + 1) // 2)
        draw = lambda *shape: np.round(rng.normal(0, 1 / np.sqrt(shape[-1]), shape), 4)
        parts[name] = branch_weights(width, channels, rng, axis) | {"width": width, "m1": draw(hidden, flat), "c1": draw(hidden) * 0.1, "m2": draw(out, hidden), "c2": draw(out) * 0.1}
    return parts


def conv_readout(states: DataFrame, weights: dict, axis: str = "nodes") -> DataFrame:
    """(fn_id, logit): mean over the product of the two branches' perceptrons.

    ``states`` is (fn_id, node_id, h, x): a node's last state and its first vector. One branch reads both, one the last state.
    """
    if axis not in ("nodes", "features"):
        raise ValueError(f"unknown axis {axis}")
    conv = conv_over_nodes if axis == "nodes" else conv_over_features
    values = None
    for name, w in weights.items():
        v = F.concat("h", "x") if name == "both" else F.col("h")
        z = conv(states.select("fn_id", "node_id", v.alias("v")), w["width"], w)
        hidden = dense([F.get("z", F.lit(k)) for k in range(w["m1"].shape[1])], w["m1"], w["c1"])
        own = z.select("fn_id", F.array(*hidden).alias("y"))
        own = own.select("fn_id", F.array(*dense([F.get("y", F.lit(k)) for k in range(len(hidden))], w["m2"], w["c2"], relu=False)).alias(name))
        values = own if values is None else values.join(own, "fn_id")
    n = len(weights["both"]["c2"])
    product = sum((F.get("both", F.lit(k)) * F.get("last", F.lit(k)) for k in range(n)), F.lit(0.0))
    return values.select("fn_id", (product / n).alias("logit"))
