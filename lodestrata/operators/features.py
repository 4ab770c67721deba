"""Vectors of tokens, nodes and graphs, and their propagation along typed edges.

Sums of vectors are one aggregate for each dimension inside one group or window, so that they stay in code-generated
JVM stages; a matrix product is an expression with the matrix as literals. Only the recurrence over several steps
runs in numpy, one whole (size-limited) graph after another, so that steps need no shuffle between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from lodestrata.operators.networks import Records, rows_of
from lodestrata.operators.trees import EDGE_TYPES
from lodestrata.session import materialize, parallelism, ship_package


def word_vectors(sentences: DataFrame, dim: int = 100, window: int = 5, min_count: int = 3, epochs: int = 10, seed: int = 1) -> DataFrame:
    """(token, vector ARRAY<DOUBLE>) by skip-gram over a column ``tokens`` (M2).

    Each epoch trains on as many parts of the sentences as the session has cores and brings their vectors together.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=sentences.sparkSession.sparkContext.defaultParallelism, inputCol="tokens", outputCol="v").fit(sentences)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def hashed_vectors(tokens: DataFrame, dim: int) -> DataFrame:
    """(token, vector): a vector of ``dim`` numbers in [0, 1) from each token's hash; the same in every engine."""
    parts = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), F.col("token"))), 1, 4), 16, 10).cast("double") / 65536 for k in range(dim)]
    return tokens.select("token", F.array(*parts).alias("vector"))


def _zeros(dim: int) -> Column:
    return F.array(*[F.lit(0.0)] * dim)


def node_features(nodes: DataFrame, vectors: DataFrame, dim: int, internal: str = "zero") -> DataFrame:
    """(fn_id, node_id, code_feat): a leaf's token vector, zeros if it has none.

    Inner nodes have zeros (``zero``) or the mean over the known leaves below them (``mean``, A15). With ``tokens`` (A16) inner
    nodes without children count as leaves too, their type being the token. Means come from running sums in
    pre-order: the sum at the end of a subtree less the sum before its node, so no node is joined with all its descendants.
    """
    if internal not in ("zero", "mean", "tokens"):
        raise ValueError(f"unknown mode {internal}")
    token = F.when(F.col("is_leaf"), F.col("code"))
    if internal == "tokens":
        token = token.when(F.col("subtree_end") == F.col("node_id"), F.col("type"))
        nodes = nodes.withColumn("is_leaf", F.col("subtree_end") == F.col("node_id")).withColumn("code", token)
        token = F.col("code")
    leaf = nodes.select("fn_id", "node_id", "subtree_end", "is_leaf", token.alias("token"))
    known = leaf.join(vectors, "token", "left")
    if internal == "zero":
        return known.select("fn_id", "node_id", F.coalesce("vector", _zeros(dim)).alias("code_feat"))
    w = Window.partitionBy("fn_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = F.array(*[F.sum(F.coalesce(F.element_at("vector", k + 1), F.lit(0.0))).over(w) for k in range(dim)])
    run = known.select("fn_id", "node_id", "subtree_end", "is_leaf", "vector", sums.alias("upto"), F.count("vector").over(w).alias("n"))
    end = run.select(F.col("fn_id").alias("f"), F.col("node_id").alias("e"), F.col("upto").alias("upto_end"), F.col("n").alias("n_end"))
    both = run.join(end, (F.col("fn_id") == F.col("f")) & (F.col("subtree_end") == F.col("e")))
    here = F.when(F.col("vector").isNotNull(), 1).otherwise(0)
    below = F.col("n_end") - F.col("n") + here
    mean = F.transform(F.arrays_zip("upto_end", "upto", F.coalesce("vector", _zeros(dim)).alias("own")), lambda z: (z["upto_end"] - z["upto"] + z["own"]) / below)
    return both.select("fn_id", "node_id", F.when(F.col("is_leaf"), F.coalesce("vector", _zeros(dim))).when(below > 0, mean).otherwise(_zeros(dim)).alias("code_feat"))


def type_embedding(kinds: DataFrame, dim: int, seed: int = 3) -> DataFrame:
    """(type_id, embedding): a normal vector of ``dim`` numbers for every type of the vocabulary, the same in every run.

    Each number is drawn from hashes of the type's number (Box and Muller), so the table is as large as the vocabulary.
    """
    uniform = lambda k, part: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("type_id"), F.lit(k))), 1 + 12 * part, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    parts = [F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(uniform(k, 1) * (2 * np.pi)) * 0.5 for k in range(dim)]
    return kinds.select("type_id").distinct().select("type_id", F.array(*parts).alias("embedding"))


def node_init(code: DataFrame, type_ids: DataFrame, embedding: DataFrame, dim: int) -> DataFrame:
    """(fn_id, node_id, h): the code vector with its type's vector of ``dim`` numbers behind it; unknown types have zeros."""
    typed = code.join(type_ids, ["fn_id", "node_id"]).join(embedding, "type_id", "left")
    return typed.select("fn_id", "node_id", F.concat("code_feat", F.coalesce("embedding", _zeros(dim))).alias("h"))


def message_step(state: DataFrame, edges: DataFrame, weights: dict[str, tuple[np.ndarray, np.ndarray]], combine: str = "sum") -> DataFrame:
    """(fn_id, node_id, m): messages along typed edges, combined for each target.

    A message is W h + b of its edge's type, times the edge's ``norm`` if there is such a column. Since it is linear,
    source vectors are added up for each (target, type) before the product. Types are then combined by sum, mean
    (over all types, absent ones counted as zeros), max (likewise) or concatenation in the types' order.
    """
    if combine not in ("sum", "mean", "max", "concat"):
        raise ValueError(f"unknown combination {combine}")
    kinds = list(weights)
    out, dim = next(iter(weights.values()))[0].shape
    norm = F.col("norm") if "norm" in edges.columns else F.lit(1.0)
    source = state.select(F.col("fn_id").alias("f"), F.col("node_id").alias("s"), "h")
    sent = edges.filter(F.col("etype").isin(kinds)).join(source, (F.col("fn_id") == F.col("f")) & (F.col("src") == F.col("s")))
    by_type = sent.groupBy("fn_id", "dst", "etype").agg(F.sum(norm).alias("w"), *[F.sum(F.element_at("h", k + 1) * norm).alias(f"x{k}") for k in range(dim)])

    def product(j: int) -> Column:
        value = None
        for kind in reversed(kinds):
            w, b = weights[kind]
            term = F.col("w") * float(b[j])
            for k in range(dim):
                term = term + F.col(f"x{k}") * float(w[j, k])
            value = F.when(F.col("etype") == kind, term) if value is None else F.when(F.col("etype") == kind, term).otherwise(value)
        return value

    typed = by_type.select("fn_id", F.col("dst").alias("node_id"), "etype", *[product(j).alias(f"m{j}") for j in range(out)])
    n = F.count(F.lit(1))
    cells = {
        "sum": lambda: [F.sum(f"m{j}") for j in range(out)],
        "mean": lambda: [F.sum(f"m{j}") / len(kinds) for j in range(out)],
        "max": lambda: [F.when(n < len(kinds), F.greatest(F.max(f"m{j}"), F.lit(0.0))).otherwise(F.max(f"m{j}")) for j in range(out)],
        "concat": lambda: [F.coalesce(F.sum(F.when(F.col("etype") == k, F.col(f"m{j}"))), F.lit(0.0)) for k in kinds for j in range(out)],
    }[combine]()
    return typed.groupBy("fn_id", "node_id").agg(F.array(*cells).alias("m"))


def random_weights(dim: int, kinds: list[str] = EDGE_TYPES, seed: int = 7) -> dict:
    """Weights of the recurrence: one matrix for each edge type, and those of the gated update."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(dim), shape)
    return {"kinds": kinds, "w": draw(len(kinds), dim, dim), "b": draw(len(kinds), dim) * 0.1, "in": draw(3, dim, dim), "rec": draw(3, dim, dim), "bias": draw(3, dim) * 0.1}


def propagate(h: np.ndarray, edges: np.ndarray, weights: dict, steps: int) -> np.ndarray:
    """States after ``steps`` gated updates (G11), in the precision of ``h``; ``edges`` are rows (type, source, target)."""
    dim = h.shape[1]
    w, b, into, rec, bias = (weights[k].astype(h.dtype, copy=False) for k in ("w", "b", "in", "rec", "bias"))
    into, rec_gates, rec_new, bias = into.reshape(3 * dim, dim).T, rec[:2].reshape(2 * dim, dim).T, rec[2].T, bias.ravel()
    by_type = []
    for k in range(len(weights["kinds"])):
        own = edges[edges[:, 0] == k]
        if len(own):
            own = own[np.argsort(own[:, 2], kind="stable")]
            to, starts, n = np.unique(own[:, 2], return_index=True, return_counts=True)
            by_type.append((w[k].T, n[:, None].astype(h.dtype) * b[k], own[:, 1], to, starts if len(to) < len(own) else None))
    for _ in range(steps):
        m = np.zeros_like(h)
        for to_message, constant, source, to, starts in by_type:
            # messages are linear, so what goes to one node is added up before the product
            sums = h[source] if starts is None else np.add.reduceat(h[source], starts, axis=0)
            m[to] += sums @ to_message + constant
        g = m @ into + bias
        gates = g[:, : 2 * dim]
        gates += h @ rec_gates
        # the logistic function by way of tanh
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        new = h @ rec_new
        new *= gates[:, :dim]
        new += g[:, 2 * dim :]
        np.tanh(new, out=new)
        h = new + gates[:, dim:] * (h - new)
    return h


def all_states(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Every node's [last state, first state], one after another."""
    return np.concatenate([last, first], axis=1).ravel()


def pooled_states(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum and maximum over the nodes."""
    both = np.concatenate([last, first], axis=1)
    return np.concatenate([both.sum(axis=0, dtype=np.float64), both.max(axis=0)])


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a column of lists of numbers, without making a Python number of any."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield values[i:j]


def list_column(rows: list[np.ndarray]) -> pa.Array:
    """A column of lists of 32-bit numbers."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.float32) if rows else np.zeros(0, np.float32)))


def byte_column(rows: list[np.ndarray]) -> pa.Array:
    """A column of the bytes of 32-bit numbers, which Spark hands on as they are and not number by number."""
    return pa.array([r.astype(np.float32, copy=False).tobytes() for r in rows], pa.binary())


def written_states(column: pa.Array, dim: int) -> Records:
    """The rows of a column of lists of numbers or of ``byte_column`` as records of vectors of ``dim`` numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return Records(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), np.diff(column.offsets.to_numpy()) // dim)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.float32)
    return Records(values.reshape(-1, dim), np.diff(offsets) // (4 * dim))


def pooled_rows(graphs: DataFrame, dim: int) -> DataFrame:
    """``graphs`` with a ``vector``, the sum and maximum over the nodes as of ``pooled_states``, in place of their written ``states``."""
    ship_package(graphs.sparkSession)
    rest = [f for f in graphs.schema.fields if f.name != "states"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = written_states(batch.column("states"), dim)
            vectors = [pooled_states(x, x[:, :0]) for x in (records[i] for i in range(len(records)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), list_column(vectors)], names=[*(f.name for f in rest), "vector"])

    return graphs.mapInArrow(run, StructType([*rest, StructField("vector", ArrayType(FloatType()))]))


def graph_states(state: DataFrame, edges: DataFrame, dim: int, steps: int = 6, weights: dict | None = None, read: Callable = all_states) -> DataFrame:
    """(fn_id, nodes, vector): what ``read`` makes of the nodes' states after ``steps`` updates and their first ones.

    ``state`` and ``edges`` must come from size-limited graphs; one graph's rows are one group.
    """
    spark = state.sparkSession
    ship_package(spark)
    weights = weights or random_weights(dim)
    sent = spark.sparkContext.broadcast(weights)
    number = F.array_position(F.array(*[F.lit(k) for k in weights["kinds"]]), F.col("etype")) - 1
    s = state.groupBy("fn_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "h"))).alias("s"))
    e = edges.filter(F.col("etype").isin(weights["kinds"])).groupBy("fn_id").agg(F.collect_set(F.struct(number.cast("int").alias("k"), "src", "dst")).alias("e"))
    graphs = s.join(e, "fn_id", "left").select(F.col("fn_id").cast("bigint"), "s.node_id", F.flatten("s.h").alias("h"), *[F.coalesce(F.col(f"e.{c}"), F.array().cast("array<int>")).alias(c) for c in ("k", "src", "dst")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, vectors = [], []
            for nodes, h, k, src, dst in zip(*(lists(c) for c in batch.columns[1:]), strict=True):
                first = h.astype(np.float64).reshape(len(nodes), -1)
                order = np.argsort(nodes)
                a, b = (np.minimum(np.searchsorted(nodes[order], x), len(nodes) - 1) for x in (src, dst))
                inside = (nodes[order][a] == src) & (nodes[order][b] == dst)
                rows = np.stack([k, order[a], order[b]], axis=1)[inside]
                last = propagate(first, rows.astype(np.int64), sent.value, steps)
                sizes.append(len(nodes))
                vectors.append(read(last, first))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), list_column(vectors)], names=["fn_id", "nodes", "vector"])

    return graphs.mapInArrow(run, "fn_id bigint, nodes int, vector array<float>")


#: Functions of one pack, and the most nodes whose states are made at once.
PACK, AT_ONCE = 64, 4096
_PACKED = "part string, pack int, fn_id array<bigint>, label array<int>, split array<string>, project array<string>, nodes array<int>, token array<int>, type array<int>, k array<int>, src array<int>, dst array<int>, vectors array<float>, types array<float>"


def _numbers(names: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each name among the known ones; -1 for others."""
    return pc.fill_null(pc.index_in(names, value_set=known, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def flat_lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All items of a column of lists, and the rows' lengths."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(left: pa.Table, right: pa.Table) -> pa.Table:
    left = left.sort_by("fn_id")
    nodes, sizes = flat_lists(left["node_id"])
    nodes = nodes.to_numpy(zero_copy_only=False).astype(np.int64)
    where = np.repeat(np.arange(len(sizes)) << 32, sizes) + nodes + (1 << 31)  # ascending: nodes are in order inside their function
    k, counts = flat_lists(left["k"])
    graph = np.repeat(np.arange(len(counts)) << 32, counts) + (1 << 31)
    ends = []
    for c in ("src", "dst"):
        wanted = graph + flat_lists(left[c])[0].to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(where, wanted), len(where) - 1)
        ends.append((at, where[at] == wanted))
    inside = ends[0][1] & ends[1][1]
    (src, _), (dst, _) = ends
    order = np.flatnonzero(inside)
    order = order[np.argsort(src[order], kind="stable")]
    is_type = right["is_type"].combine_chunks()
    parts = {}
    for name, own in (("token", right.filter(pc.invert(is_type))), ("type", right.filter(is_type))):
        own = own.sort_by("term")
        known = pa.array(own["term"].to_pylist(), pa.string())
        parts[name] = _numbers(flat_lists(left[name])[0], known), flat_lists(own["vector"])[0].to_numpy(zero_copy_only=False)
    row = [left["part"][0].as_py(), left["pack"][0].as_py(), *(left[c].to_pylist() for c in ("fn_id", "label", "split", "project")), sizes, parts["token"][0], parts["type"][0], k.to_numpy(zero_copy_only=False)[order], src[order], dst[order], parts["token"][1], parts["type"][1]]
    kinds = [pa.string(), pa.int32(), *(pa.list_(t) for t in (pa.int64(), pa.int32(), pa.string(), pa.string())), *[pa.list_(pa.int32())] * 6, *[pa.list_(pa.float32())] * 2]
    return pa.table([pa.array([x.astype(np.int32) if isinstance(x, np.ndarray) and x.dtype.kind == "i" else x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])


def packed(functions: DataFrame, terms: list[tuple[str, DataFrame]], pack: Callable[[pa.Table, pa.Table], pa.Table], schema: str, by: list[str] | None = None) -> DataFrame:
    """Functions by ``PACK``, each pack with the vectors of the terms that it holds, so that no vector is sent or kept for each place it stands at.

    ``functions`` must be a written table, with a column of lists of terms for each of ``terms``: the column's name and (term, vector
    array<float>). ``pack`` gets a pack's functions and its (of_pack, is_type, term, vector), ``is_type`` marking all but the first list. Packs don't mix values of ``by``.
    """
    spark = functions.sparkSession
    ship_package(spark)
    tasks = max(parallelism(spark), 6 * spark.sparkContext.defaultParallelism)
    keys = [*(by or []), "pack"]
    rows = functions.withColumn("pack", F.pmod(F.xxhash64("fn_id"), F.lit(max(1, -(-functions.count() // PACK)))).cast("int"))
    held = None
    for i, (name, vectors) in enumerate(terms):
        distinct = rows.select(*keys, F.explode(F.array_distinct(name)).alias("term")).distinct()
        own = distinct.join(vectors, "term").select(*keys, F.lit(i > 0).alias("is_type"), "term", "vector")
        held = own if held is None else held.unionByName(own)
    of = [f"of_{k}" for k in keys]
    held = held.select(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)], "is_type", "term", "vector")
    both = rows.repartition(tasks, *keys).groupBy(*keys).cogroup(held.repartition(tasks, *of).groupBy(*of))
    return both.applyInArrow(pack, schema)


def packed_graphs(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, types: DataFrame, labels: DataFrame) -> DataFrame:
    """Packs of whole, size-limited graphs: their nodes in order with the numbers of their token and type among the pack's vectors
    (-1 for unknown ones), distinct edges inside them by type's number and places, and the vectors.

    ``vectors`` is (token, vector), ``types`` (type, vector), ``labels`` (fn_id, label, split, project) of the functions that have a label
    and a split. Packs don't mix the ``part`` s train, val, rest (other splits) and none (functions without label), so that states get their labels without a join.
    """
    number = F.array_position(F.array(*[F.lit(k) for k in EDGE_TYPES]), F.col("etype")) - 1
    slim = nodes.select("fn_id", F.struct("node_id", F.when(F.col("is_leaf"), F.col("code")).alias("token"), "type").alias("n"))
    s = slim.groupBy("fn_id").agg(F.array_sort(F.collect_list("n")).alias("s"))
    e = edges.filter(F.col("etype").isin(EDGE_TYPES)).groupBy("fn_id").agg(F.collect_set(F.struct(number.cast("int").alias("k"), "src", "dst")).alias("e"))
    lists_ = [F.coalesce(F.col(f"e.{c}"), F.array().cast("array<int>")).alias(c) for c in ("k", "src", "dst")]
    part = F.when(F.col("split").isin("train", "val"), F.col("split")).when(F.col("split").isNotNull(), "rest").otherwise("none").alias("part")
    own = [F.col("label").cast("int").alias("label"), "split", "project", part]
    graphs = s.join(e, "fn_id", "left").join(labels, "fn_id", "left").select(F.col("fn_id").cast("bigint"), "s.node_id", "s.token", "s.type", *lists_, *own)
    terms = [(name, df.select(F.col(name).alias("term"), F.col("vector").cast("array<float>"))) for name, df in (("token", vectors), ("type", types))]
    return packed(materialize(graphs, "graphs"), terms, _pack, _PACKED, ["part"])


def apart(targets: np.ndarray, token: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes whose states must be made, and the place of each node's state among theirs: nodes that no edge reaches differ by token and type alone."""
    reached = np.zeros(len(token), bool)
    reached[targets] = True
    active, idle = np.flatnonzero(reached), np.flatnonzero(~reached)
    _, at, same = np.unique((token[idle].astype(np.int64) << 32) + kind[idle], return_index=True, return_inverse=True)
    place = np.empty(len(token), np.int64)
    place[active], place[idle] = np.arange(len(active)), len(active) + same
    return np.concatenate([active, idle[at]]), place


def packed_states(packs: DataFrame, code_dim: int, type_dim: int, weights: dict, steps: int = 6, read: Callable = all_states, raw: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """(fn_id, nodes, vector) as of ``graph_states``, of ``packed_graphs``, in 32 bits; only edges of the weights' ``kinds`` count. With ``raw`` vectors are the numbers' bytes.

    ``also``: what else of each function comes along, columns of the packs.
    """
    spark = packs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(weights)
    numbers = np.full(len(EDGE_TYPES), -1)
    numbers[[EDGE_TYPES.index(k) for k in weights["kinds"]]] = range(len(weights["kinds"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = {k: v if k == "kinds" else v.astype(np.float32) for k, v in sent.value.items()}
        for batch in batches:
            for i, row in enumerate(zip(*(lists(batch.column(c)) for c in ("nodes", "token", "type", "k", "src", "dst", "vectors", "types")), strict=True)):
                own_columns = [batch.column(c)[i].values for c in ("fn_id", *also)]
                sizes, token, kind, k, src, dst, vectors, types = row
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                edges = np.stack([numbers[k], src, dst], axis=1)[numbers[k] >= 0]
                out, at = [], 0
                while at < len(sizes):
                    j = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, "right")) - 1)
                    a, z = bounds[at], bounds[j]
                    first = np.concatenate([rows_of(vectors.reshape(-1, code_dim), token[a:z]), rows_of(types.reshape(-1, type_dim), kind[a:z])], axis=1)
                    own = edges[slice(*np.searchsorted(edges[:, 1], [a, z]))] - [0, a, a]
                    kept, place = apart(own[:, 2], token[a:z], kind[a:z])
                    last = propagate(first[kept], np.stack([own[:, 0], place[own[:, 1]], place[own[:, 2]]], axis=1), w, steps)[place]
                    out += [read(last[p:q], first[p:q]) for p, q in zip(bounds[at:j] - a, bounds[at + 1 : j + 1] - a, strict=True)]
                    at = j
                yield pa.RecordBatch.from_arrays([*own_columns, pa.array(sizes, pa.int32()), (byte_column if raw else list_column)(out)], names=["fn_id", *also, "nodes", "vector"])

    kinds = "".join(f"{c} {packs.schema[c].dataType.elementType.simpleString()}, " for c in also)
    return packs.mapInArrow(run, f"fn_id bigint, {kinds}nodes int, vector {'binary' if raw else 'array<float>'}")


_SEQUENCES = "split string, fn_id array<bigint>, label array<int>, project array<string>, sizes array<int>, token array<int>, vectors array<float>"


def _pack_sequences(left: pa.Table, right: pa.Table) -> pa.Table:
    left, own = left.sort_by("fn_id"), right.sort_by("term")
    tokens, sizes = flat_lists(left["token"])
    numbers = _numbers(tokens, pa.array(own["term"].to_pylist(), pa.string()))
    vectors = flat_lists(own["vector"])[0]
    row = [left["split"][0].as_py(), *(left[c].to_pylist() for c in ("fn_id", "label", "project")), sizes.astype(np.int32), numbers, vectors.to_numpy(zero_copy_only=False)]
    kinds = [pa.string(), *(pa.list_(t) for t in (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float32()))]
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _SEQUENCES.split(", ")])


def packed_sequences(functions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Packs of functions (fn_id, label, split, project, token ARRAY<STRING>) of one split: their tokens' numbers among the pack's vectors, -1 for tokens without one.

    ``functions`` must be a written table; ``vectors`` is (token, vector).
    """
    terms = [("token", vectors.select(F.col("token").alias("term"), F.col("vector").cast("array<float>")))]
    return packed(functions, terms, _pack_sequences, _SEQUENCES, ["split"])
