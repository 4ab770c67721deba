"""Queries that learn: token vectors, node features, propagation, classifiers on metrics, graphs and tokens, ablation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.texts import name_of, sigmoid
from lodestrata.operators import artifacts, classifier_metrics, features, networks, readout, splits, training, trees
from lodestrata.plans import corpus, graphs
from lodestrata.session import forget, materialize, scratch, table, work_dir

#: Numbers of a token's vector and of a type's embedding, as trained.
CODE_DIM, TYPE_DIM = 100, 100
#: Numbers of the hashed token vectors that SQL can say as well.
DIM = 4
STEP_TYPES = graphs.RELATIONAL_TYPES


def step_weights() -> dict:
    """Small fixed weights for the one-step query."""
    return {k: (np.array([[0.5 + 0.1 * i, -0.2], [0.3, 0.1 * i]]), np.array([0.01 * i, 0.02])) for i, k in enumerate(STEP_TYPES)}


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(trees.sized(trees.clean(table(spark, sf_dir, "ast_nodes"))), "nodes")


def _hashed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = _nodes(spark, sf_dir)
    tokens = graphs.token_counts(spark, sf_dir).select("token")
    return nodes, features.hashed_vectors(tokens, DIM)


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-gram vectors of the leaf tokens: 100 numbers, ten epochs."""
    return features.word_vectors(trees.leaf_tokens(_nodes(spark, sf_dir)))


def node_features_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed token vectors of leaves, zeros elsewhere (M3)."""
    return features.node_features(*_hashed(spark, sf_dir), DIM, "zero")


def node_features_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed token vectors of leaves, subtree means elsewhere."""
    out = features.node_features(*_hashed(spark, sf_dir), DIM, "mean")
    return out.select("fn_id", "node_id", F.transform("code_feat", lambda x: F.round(x, 6)).alias("code_feat"))


def code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of hashed vectors over all childless nodes below each node, with the type as token where there is no text."""
    out = features.node_features(*_hashed(spark, sf_dir), DIM, "tokens")
    return out.select("fn_id", "node_id", F.transform("code_feat", lambda x: F.round(x, 6)).alias("code_feat"))


def _message_step(combine: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = materialize(trees.clean(table(spark, sf_dir, "ast_nodes")), "nodes")
        state = nodes.select("fn_id", "node_id", F.array(F.when(F.col("is_leaf"), 1.0).otherwise(0.0), (F.col("node_id") % 7) / 7.0).alias("h"))
        edges = graphs.relational_edges(nodes)
        out = features.message_step(state, edges, step_weights(), combine)
        return out.select("fn_id", "node_id", F.transform("m", lambda x: F.round(x, 6)).alias("m"))

    run.__doc__ = f"One step of messages along syntax, token and data-flow edges, types combined by {combine} (G9, J10)."
    return run


def conv_weights(axis: str) -> dict:
    """Fixed weights of the convolutional readout over one step's messages."""
    return readout.readout_weights(2 if axis == "nodes" else 4, 2, axis=axis)


def _conv_logits(axis: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = materialize(trees.clean(table(spark, sf_dir, "ast_nodes")), "nodes")
        first = nodes.select("fn_id", "node_id", F.array(F.when(F.col("is_leaf"), 1.0).otherwise(0.0), (F.col("node_id") % 7) / 7.0).alias("h"))
        edges = graphs.relational_edges(nodes)
        got = features.message_step(first, edges, step_weights(), "sum")
        both = first.withColumnRenamed("h", "x").join(got, ["fn_id", "node_id"], "left")
        h = F.coalesce("m", F.array(F.lit(0.0), F.lit(0.0)))
        states = both.select("fn_id", "node_id", (h if axis == "nodes" else F.concat(h, "x")).alias("h"), "x")
        return readout.conv_readout(states, conv_weights(axis), axis)

    return run


def _conv_readout(axis: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _conv_logits(axis)(spark, sf_dir).select("fn_id", F.round("logit", 6).alias("logit"))

    run.__doc__ = f"Logit of each function by the convolutional readout along {axis} (M8, M9)."
    return run


def conv_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and verdict at 0.5 of the convolutional readout along the nodes."""
    prob = sigmoid(F.col("logit"))
    return _conv_logits("nodes")(spark, sf_dir).select("fn_id", F.round(prob, 6).alias("prob"), (prob >= 0.5).cast("int").alias("predicted"))


def _type_ids(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, type_id), and (fn_id, node_id, type_id) with 0 for unknown types."""
    kinds = materialize(trees.vocabulary(nodes, "type", ["fn_id", "node_id"], 1, "type_id").withColumnRenamed("term", "type"), "types")
    return kinds, nodes.join(kinds, "type", "left").select("fn_id", "node_id", F.coalesce("type_id", F.lit(0)).alias("type_id"))


def _initial(nodes: DataFrame, vectors: DataFrame, dim: int, type_dim: int) -> DataFrame:
    """(fn_id, node_id, h): first states, a token's vector with a type's behind it."""
    kinds, type_ids = _type_ids(nodes)
    return features.node_init(features.node_features(nodes, vectors, dim, "zero"), type_ids, features.type_embedding(kinds, type_dim), type_dim)


def message_step_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of messages along all seven edge types between first states of hashed token vectors and type embeddings."""
    nodes, vectors = _hashed(spark, sf_dir)
    w = features.random_weights(2 * DIM)
    weights = {k: (w["w"][i], w["b"][i]) for i, k in enumerate(w["kinds"])}
    edges = trees.distinct_edges(trees.all_edges(nodes))
    return features.message_step(_initial(nodes, vectors, DIM, DIM), edges, weights).select("fn_id", "node_id", F.transform("m", lambda x: F.round(x, 6)).alias("m"))


class Corpus:
    """What the graph and sequence models share: size-limited trees, trained token vectors, packs of graphs, each written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.nodes = _nodes(spark, sf_dir)

    @cached_property
    def vectors(self) -> DataFrame:
        """(token, vector ARRAY<FLOAT>) as trained."""
        return materialize(features.word_vectors(trees.leaf_tokens(self.nodes), CODE_DIM).withColumn("vector", F.col("vector").cast("array<float>")), "vectors")

    @cached_property
    def packs(self) -> DataFrame:
        """The graphs with their token vectors and type embeddings; models of sequences don't ask for them."""
        kinds = materialize(trees.vocabulary(self.nodes, "type", ["fn_id", "node_id"], 1, "type_id").withColumnRenamed("term", "type"), "types")
        types = kinds.join(features.type_embedding(kinds, TYPE_DIM), "type_id").select("type", F.col("embedding").alias("vector"))
        return materialize(features.packed_graphs(self.nodes, trees.all_edges(self.nodes), self.vectors, types, _labels(self.spark, self.sf_dir)), "packs")

    def states(self, read: Callable, kinds: list[str] | None = None) -> DataFrame:
        """(fn_id, nodes, vector) after six gated updates along edges of ``kinds`` (all by default)."""
        return features.packed_states(self.packs, CODE_DIM, TYPE_DIM, features.random_weights(CODE_DIM + TYPE_DIM, kinds or trees.EDGE_TYPES), read=read)

    def labelled(self, read: Callable, kinds: list[str] | None = None) -> DataFrame:
        """(fn_id, vector, label, split, project) of the functions with a label and a split."""
        return _labelled(self.states(read, kinds).select("fn_id", "vector"), self.spark, self.sf_dir)

    @cached_property
    def nodes_labelled(self) -> DataFrame:
        """(fn_id, states, label, split, project), in files of one split each: every model reads its part of them and makes no copy.

        They are by far the largest table, so they go from the packs to their files without a shuffle or sort, and only those of labelled functions.
        """
        weights = features.random_weights(CODE_DIM + TYPE_DIM, trees.EDGE_TYPES)
        rows = features.packed_states(self.packs.filter("part <> 'none'"), CODE_DIM, TYPE_DIM, weights, raw=True, also=("label", "split", "project"))
        part = F.when(F.col("split").isin("train", "val"), F.col("split")).otherwise("rest").alias("part")
        return materialize(rows.select("fn_id", F.col("vector").alias("states"), "label", "split", "project", part), "states", by=("part",))


def graph_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of each function's graph after six gated updates of trained token vectors and type embeddings."""
    return Corpus(spark, sf_dir).states(features.pooled_states)


def graph_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each kept graph: token vectors and type numbers of its nodes in pre-order, distinct edges of each type, label and project."""
    nodes = _nodes(spark, sf_dir)
    vectors = materialize(features.word_vectors(trees.leaf_tokens(nodes), CODE_DIM), "vectors")
    return samples(nodes, trees.distinct_edges(trees.all_edges(nodes)), vectors, _type_ids(nodes)[1], _labels(spark, sf_dir))


def samples(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, type_ids: DataFrame, labels: DataFrame, dim: int = CODE_DIM, internal: str = "zero") -> DataFrame:
    """(fn_id, num_nodes, code_feat, type_ids, edges, label, split, project): featurised graphs of the functions in ``labels``."""
    code = features.node_features(nodes, vectors, dim, internal).join(type_ids, ["fn_id", "node_id"])
    one = code.groupBy("fn_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "code_feat", "type_id"))).alias("n"))
    by_type = edges.groupBy("fn_id", "etype").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e")).groupBy("fn_id").agg(F.map_from_entries(F.collect_list(F.struct("etype", "e"))).alias("edges"))
    graphs_ = one.join(by_type, "fn_id", "left").join(labels, "fn_id")
    return graphs_.select("fn_id", F.size("n").alias("num_nodes"), F.col("n.code_feat").alias("code_feat"), F.col("n.type_id").alias("type_ids"), "edges", "label", "split", "project")


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every number of the token vocabulary: the trained one, else small hashed noise; zeros for 0, the padding (M5)."""
    nodes = _nodes(spark, sf_dir)
    vocabulary = graphs.token_vocabulary(spark, sf_dir)
    return matrix(vocabulary, features.word_vectors(trees.leaf_tokens(nodes), CODE_DIM))


def matrix(vocabulary: DataFrame, vectors: DataFrame, dim: int = CODE_DIM, deviation: float = 0.1) -> DataFrame:
    """(token_id, token, trained, vector) of a vocabulary (token, token_id) and the two numbers 0 (padding) and 1 (unknown)."""
    spark = vocabulary.sparkSession
    special = spark.createDataFrame([(0, None), (1, None)], "token_id bigint, token string")
    rows = vocabulary.select("token_id", "token").unionByName(special).join(vectors.select("token", "vector"), "token", "left")
    # normal noise: the sum of twelve even numbers has deviation one
    noise = lambda k: sum((F.conv(F.substring(F.md5(F.concat_ws(":", "token_id", F.lit(k))), 1 + 2 * i, 2), 16, 10).cast("double") for i in range(12)), F.lit(0.0)) / 256 - F.lit(12 * 127.5 / 256)
    drawn = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.when(F.col("token_id") == 0, 0.0).otherwise(noise(k) * deviation))
    return rows.select("token_id", "token", F.col("vector").isNotNull().alias("trained"), F.coalesce("vector", drawn).alias("vector"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "raw_functions").filter("target IS NOT NULL AND split IS NOT NULL")
    return labels.select("fn_id", F.col("target").alias("label"), "split", name_of("project").alias("project"))


def _labelled(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join(_labels(spark, sf_dir), "fn_id")


def _fit_and_score(rows: DataFrame, estimator) -> DataFrame:
    """(fn_id, project, label, split, prob) of val and test rows by a model fitted on train rows; nothing where train has one class only."""
    from pyspark.ml.functions import vector_to_array

    rows = materialize(rows, "training")
    train = rows.filter("split = 'train'")
    if train.select("label").distinct().count() < 2:
        return rows.limit(0).select("fn_id", "project", "label", "split", F.lit(0.0).alias("prob"))
    scored = estimator.fit(train).transform(rows.filter("split <> 'train'"))
    return scored.select("fn_id", "project", "label", "split", vector_to_array("probability")[1].alias("prob"))


def _logistic():
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=False), LogisticRegression(maxIter=30, regParam=0.05)])


def metrics_classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the 15 metrics of each function, ``ROUNDS`` of depth 6, scored on val and test."""
    return _metrics_scores(_nodes(spark, sf_dir), spark, sf_dir)


def _metrics_scores(nodes: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = _labelled(trees.function_metrics(nodes, trees.all_edges(nodes)), spark, sf_dir)
    work_dir(spark)  # every tenth tree's errors are checkpointed there
    boosted = GBTClassifier(maxIter=ROUNDS, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=1, checkpointInterval=10)
    return _fit_and_score(rows, Pipeline(stages=[VectorAssembler(inputCols=trees.METRIC_NAMES, outputCol="features"), boosted]))


def _with_raw(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("raw", array_to_vector("vector")).drop("vector")


def _graph_scores(data: Corpus, kinds: list[str] | None = None) -> DataFrame:
    return _fit_and_score(_with_raw(data.labelled(features.pooled_states, kinds)), _logistic())


def _pooled_scores(data: Corpus) -> DataFrame:
    """The scores of ``_graph_scores`` over all edge types, from the written states."""
    rows = data.nodes_labelled.select("fn_id", "states", "label", "split", "project")
    return _fit_and_score(_with_raw(features.pooled_rows(rows, 2 * (CODE_DIM + TYPE_DIM))), _logistic())


def graph_classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic readout over propagated graph vectors, scored on val and test."""
    return _graph_scores(Corpus(spark, sf_dir))


#: Boosted trees.
ROUNDS = 200
#: Rate of the networks, whose gradients aren't scaled as the summed perceptron's are.
NETWORK_RATE = 0.003


def _trained_scores(rows: DataFrame, dim: int, settings: training.Settings | None = None, net: networks.Network | None = None) -> tuple[DataFrame, np.ndarray]:
    """(fn_id, project, label, split, prob) of val and test rows by a network trained on train rows (fn_id, label, split, project, states) or packs, of a written table, and its parameters."""
    settings = settings or training.Settings()
    flat, _ = training.train(rows, dim, settings, net=net, written=True)
    held = rows.filter("split <> 'train'")
    return training.predict(held, flat, dim, settings, net).join(training.unpacked(held), "fn_id").select("fn_id", "project", "label", "split", "prob"), flat


def _readout_scores(data: Corpus, settings: training.Settings | None = None) -> tuple[DataFrame, np.ndarray]:
    return _trained_scores(data.nodes_labelled, 2 * (CODE_DIM + TYPE_DIM), settings)


def _conv_scores(data: Corpus, settings: training.Settings | None = None) -> tuple[DataFrame, np.ndarray]:
    state = CODE_DIM + TYPE_DIM
    net = networks.CompositeReadout(state, state)
    return _trained_scores(data.nodes_labelled, 2 * state, settings or training.Settings(rate=NETWORK_RATE), net)


def conv_classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite model: trained convolutions along the propagated nodes, two branches, scored on val and test (M8, M9)."""
    return _conv_scores(Corpus(spark, sf_dir))[0]


def _token_packs(data: Corpus, max_tokens: int = graphs.MAX_TOKENS) -> DataFrame:
    """Packs of labelled functions: the trained vectors of a function's leaves in source order, zeros for rare tokens, cut to ``max_tokens`` as the model takes them (M7)."""
    cut = trees.leaf_tokens(data.nodes).select("fn_id", F.slice("tokens", F.lit(1), F.lit(max_tokens)).alias("token"))
    rows = materialize(_labelled(cut, data.spark, data.sf_dir).withColumn("label", F.col("label").cast("int")), "sequences")
    return materialize(features.packed_sequences(rows, data.vectors), "tokens")


def _token_conv_scores(data: Corpus, settings: training.Settings | None = None) -> tuple[DataFrame, np.ndarray]:
    return _trained_scores(_token_packs(data), CODE_DIM, settings or training.Settings(rate=NETWORK_RATE), networks.TokenConvolution(CODE_DIM))


def token_conv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained filters over runs of three to five tokens, scored on val and test."""
    return _token_conv_scores(Corpus(spark, sf_dir))[0]


def _recurrent_scores(data: Corpus, attention: bool, settings: training.Settings | None = None) -> tuple[DataFrame, np.ndarray]:
    return _trained_scores(_token_packs(data), CODE_DIM, settings or training.Settings(rate=NETWORK_RATE), networks.MemorySequence(CODE_DIM, attention=attention))


def recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained memory cells over a function's tokens in both directions, their mean, scored on val and test."""
    return _recurrent_scores(Corpus(spark, sf_dir), False)[0]


def recurrent_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with attention in place of the mean."""
    return _recurrent_scores(Corpus(spark, sf_dir), True)[0]


def readout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perceptron summed over the propagated nodes, trained with early stopping on val, scored on val and test."""
    return _readout_scores(Corpus(spark, sf_dir))[0]


def _token_scores(rows: DataFrame) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, VectorAssembler

    stages = [NGram(n=3, inputCol="tokens", outputCol="runs"), HashingTF(inputCol="tokens", outputCol="one", numFeatures=4096), HashingTF(inputCol="runs", outputCol="three", numFeatures=4096)]
    stages += [VectorAssembler(inputCols=["one", "three"], outputCol="features"), LogisticRegression(maxIter=20, regParam=0.1)]
    return _fit_and_score(rows, Pipeline(stages=stages))


def token_classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic model over hashed token runs of each function, the sequence baseline, scored on val and test."""
    return _token_scores(_labelled(trees.leaf_tokens(_nodes(spark, sf_dir)), spark, sf_dir))


def _measured(scored: DataFrame, model: str) -> DataFrame:
    """Metrics on val and test at the threshold that is best on val."""
    return artifacts.measured(materialize(scored, "scored"))[1].withColumn("model", F.lit(model))


#: Models that are compared by their metrics on val, as they have no part in choosing a checkpoint there.
BASELINES = ["metrics", "tokens", "token_convolution"]


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the classifiers on val and test, for each project and combined; ``headline`` marks the rows that stand in the results' table:
    graph models on test, baselines on val (E13)."""
    def measured(name: str, scores: Callable[[], DataFrame]) -> DataFrame:
        with scratch(spark):
            rows = materialize(_measured(scores(), name), "measured", keep=True)
        forget(spark)
        return rows

    # boosting is hundreds of small jobs of one task or two: states are made beside it, models one after another for the driver's memory
    with scratch(spark), ThreadPoolExecutor(1) as pool:
        data = Corpus(spark, sf_dir)
        parts = [pool.submit(measured, "metrics", lambda: _metrics_scores(data.nodes, spark, sf_dir))]
        data.vectors, data.nodes_labelled  # noqa: B018  # once for all models that read them
        parts += [pool.submit(measured, "convolution", lambda: _conv_scores(data)[0]), pool.submit(measured, "token_convolution", lambda: _token_conv_scores(data)[0])]
        parts += [pool.submit(measured, "readout", lambda: _readout_scores(data)[0]), pool.submit(measured, "graph", lambda: _pooled_scores(data))]
        parts += [pool.submit(measured, "tokens", lambda: _token_scores(_labelled(trees.leaf_tokens(data.nodes), spark, sf_dir)))]
        rows = reduce(DataFrame.unionByName, [part.result() for part in parts])
    return rows.withColumn("headline", F.col("split") == F.when(F.col("model").isin(BASELINES), "val").otherwise("test"))


def edge_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test metrics of the graph classifier with each single edge type and with all seven."""
    data = Corpus(spark, sf_dir)
    kinds = {k: [k] for k in trees.EDGE_TYPES if k != "REV_AST"} | {"all": trees.EDGE_TYPES}

    def one(name: str) -> DataFrame:
        with scratch(spark):  # a model's vectors go when its scores are written
            scored = materialize(_graph_scores(data, kinds[name]), "scored", keep=True)
        return _measured(scored, name)

    data.packs  # noqa: B018  # written before the models ask for it
    with ThreadPoolExecutor(3) as pool:  # the small jobs of one model's fit run beside the states of the next
        parts = list(pool.map(one, kinds))
    out = reduce(DataFrame.unionByName, parts)
    return out.filter((F.col("project") == classifier_metrics.COMBINED) & (F.col("split") == "test")).withColumnRenamed("model", "edges").drop("project", "split")


def leakage_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, F1 and AUC on val of a model refitted on a random and on a commit-disjoint split of the same functions, and the gap."""
    rows = corpus.cleaned(table(spark, sf_dir, "raw_functions")).filter("target IS NOT NULL").select("fn_id", "target", "commit_id", "project")
    tokens = materialize(trees.leaf_tokens(_nodes(spark, sf_dir)).join(rows, "fn_id"), "tokens")
    out = None
    for by in ("random", "commit"):
        part = splits.split_rows(tokens, {"split_by": by})
        scored = materialize(_token_scores(part.withColumn("label", F.col("target")).withColumnRenamed("part", "split")), "scored").filter("split = 'val'").withColumn("g", F.lit(1))
        best = classifier_metrics.best_threshold(scored, ["g"])
        at = classifier_metrics.apply_threshold(scored, best, ["g"]).withColumn("prob", F.col("predicted").cast("double"))
        own = classifier_metrics.project_metrics(at).filter(F.col("project") == classifier_metrics.COMBINED).withColumn("g", F.lit(1))
        own = own.join(classifier_metrics.auc(scored, ["g"]), "g").select("g", *[F.col(k).alias(f"{k}_{by}") for k in ("accuracy", "f1", "auc")])
        out = own if out is None else out.join(own, "g")
    return out.drop("g").select("*", *[F.round(F.col(f"{k}_random") - F.col(f"{k}_commit"), 2).alias(f"{k}_gap") for k in ("accuracy", "f1", "auc")])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each scored function: probability, threshold, verdict, nodes and edges of each type; an error where it has no graph."""
    scored = table(spark, sf_dir, "scored").filter("prob IS NOT NULL")
    best = classifier_metrics.best_threshold(scored.filter("split = 'val'"), ["project"])
    decided = classifier_metrics.apply_threshold(scored, best, ["project"]).select("fn_id", "prob", "threshold", "predicted")
    nodes = materialize(trees.clean(table(spark, sf_dir, "ast_nodes")), "nodes")
    counts = trees.edge_counts(trees.all_edges(nodes), nodes).groupBy("fn_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("etype", "n")))).alias("edges"))
    sizes = nodes.groupBy("fn_id").agg(F.count(F.lit(1)).alias("num_nodes"))
    joined = decided.join(sizes, "fn_id", "left").join(counts, "fn_id", "left")
    error = F.when(F.col("num_nodes").isNull(), F.lit("no graph")).alias("error")
    return joined.select("fn_id", "prob", "threshold", "predicted", "num_nodes", *[F.col("edges")[k].alias(k.lower()) for k in trees.EDGE_TYPES], error)


QUERIES = {f.__name__: f for f in (
    word_vectors, node_features_zero, node_features_mean, code_vectors, message_step_all, graph_vectors, graph_samples, embedding_matrix, conv_probabilities, metrics_classifier_scores, graph_classifier_scores,
    conv_classifier_scores, readout_scores, token_classifier_scores, token_conv_scores, recurrent_scores, recurrent_attention_scores, model_table, edge_ablation, leakage_refit, predictions,
)} | {
    "conv_readout": _conv_readout("nodes"), "conv_readout_features": _conv_readout("features"),
    "message_step": _message_step("sum"), "message_step_mean": _message_step("mean"), "message_step_max": _message_step("max"), "message_step_concat": _message_step("concat"),
}

_HASHED = f"""{graphs._SIZED}, all_leaves AS (
    SELECT n.code FROM (SELECT DISTINCT ON (fn_id, node_id) * FROM ast_nodes) n JOIN raw_functions f ON f.fn_id = n.fn_id WHERE is_leaf AND code IS NOT NULL
), vectors AS (
    SELECT code AS token, [{", ".join(f"CAST(('0x' || md5('{k}:' || code)[1:4]) AS INTEGER) / CAST(65536 AS DOUBLE)" for k in range(DIM))}] AS vector FROM all_leaves GROUP BY code HAVING count(*) >= 3
)"""


def _dense_sql(inputs: list[str], weights: np.ndarray, bias: np.ndarray, relu: bool = True) -> list[str]:
    sums = [" + ".join([f"({float(b)!r})", *[f"{x} * ({float(v)!r})" for x, v in zip(inputs, row, strict=True)]]) for row, b in zip(weights, bias, strict=True)]
    return [f"greatest({x}, 0.0)" if relu else x for x in sums]


def _named(cells: list[str], name: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {name}{k}" for k, c in enumerate(cells))


def _conv_sql(axis: str, cells_out: str = "round(logit, 6) AS logit") -> str:
    weights, steps = conv_weights(axis), _step_sql("sum", digits=None)
    cells = ["coalesce(m[1], 0)", "coalesce(m[2], 0)", "h0", "h1"]
    own = {"both": cells, "last": cells[:2]} if axis == "nodes" else {"both": [*cells, *cells[2:]], "last": cells}
    head, _, tail = steps.rpartition("SELECT fn_id, node_id, [")
    sql = f"{head.rstrip()}, got AS (SELECT fn_id, node_id, [{tail}), states AS (SELECT s.fn_id, s.node_id, h0, h1, m FROM state s LEFT JOIN got g ON g.fn_id = s.fn_id AND g.node_id = s.node_id)"
    for name, w in weights.items():
        n, channels = w["width"], len(w["b1"])
        sql += f", v_{name} AS (SELECT fn_id, node_id, {_named(own[name], 'v')} FROM states)"
        if axis == "nodes":
            near = ", ".join([f"lag(v{k}, 1, 0) OVER w AS p{k}, v{k}, lead(v{k}, 1, 0) OVER w AS q{k}" for k in range(n)])
            sql += f", near_{name} AS (SELECT fn_id, node_id, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY fn_id) AS n, {near} FROM v_{name} WINDOW w AS (PARTITION BY fn_id ORDER BY node_id))"
            first = _dense_sql([f"{c}{k}" for c in "pvq" for k in range(n)], w["first"], w["b1"])
            sql += f", first_{name} AS (SELECT fn_id, place, n, {_named(first, 'a')} FROM near_{name})"
            three = ", ".join(f"max(a{k}) OVER w AS a{k}" for k in range(channels))
            sql += f", pool_{name} AS (SELECT fn_id, place, n, {three} FROM first_{name} WINDOW w AS (PARTITION BY fn_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"
            second = [f"max({c})" for c in _dense_sql([f"a{k}" for k in range(channels)], w["second"], w["b2"])]
            sql += f", z_{name} AS (SELECT fn_id, {_named(second, 'z')} FROM pool_{name} WHERE place % 2 = 0 AND place < greatest(n, 4) - 1 GROUP BY fn_id)"
        else:
            padded = ["0.0", *[f"v{k}" for k in range(n)], "0.0"]
            first = [c for j in range(n) for c in _dense_sql(padded[j : j + 3], w["first"], w["b1"])]
            sql += f", first_{name} AS (SELECT fn_id, {_named(first, 'a')} FROM v_{name})"
            windows = [[j for j in range(s, s + 3) if j < n] for s in range(0, n, 2) if s == 0 or s < n - 1]
            second = [_dense_sql([f"greatest({', '.join(f'a{j * channels + k}' for j in js)})" for k in range(channels)], w["second"], w["b2"]) for js in windows]
            pairs = [second[s : s + 2] for s in range(0, len(second), 2)]
            sql += f", z_{name} AS (SELECT fn_id, {_named([f'max(greatest({chr(44).join(place[k] for place in pair)}))' for k in range(channels) for pair in pairs], 'z')} FROM first_{name} GROUP BY fn_id)"
        hidden = _dense_sql([f"z{k}" for k in range(w["m1"].shape[1])], w["m1"], w["c1"])
        sql += f", y_{name} AS (SELECT fn_id, {_named(hidden, 'y')} FROM z_{name}), o_{name} AS (SELECT fn_id, {_named(_dense_sql([f'y{k}' for k in range(len(hidden))], w['m2'], w['c2'], relu=False), 'o')} FROM y_{name})"
    n = len(weights["both"]["c2"])
    return f"{sql} SELECT fn_id, {cells_out} FROM (SELECT b.fn_id, ({' + '.join(f'b.o{k} * l.o{k}' for k in range(n))}) / {n} AS logit FROM o_both b JOIN o_last l ON l.fn_id = b.fn_id)"


def _step_sql(combine: str, digits: int | None = 6) -> str:
    w = step_weights()

    def product(j: int) -> str:
        return "CASE etype " + " ".join(f"WHEN '{k}' THEN w * ({b[j]!r}) + x0 * ({m[j, 0]!r}) + x1 * ({m[j, 1]!r})" for k, (m, b) in ((k, (m.astype(object), b.astype(object))) for k, (m, b) in w.items())) + " END"

    cells = {
        "sum": [f"round(sum(m{j}), {digits})" if digits else f"sum(m{j})" for j in range(2)],
        "mean": [f"round(sum(m{j}) / {len(STEP_TYPES)}, 6)" for j in range(2)],
        "max": [f"round(CASE WHEN count(*) < {len(STEP_TYPES)} THEN greatest(max(m{j}), 0) ELSE max(m{j}) END, 6)" for j in range(2)],
        "concat": [f"round(coalesce(sum(CASE WHEN etype = '{k}' THEN m{j} END), 0), 6)" for k in STEP_TYPES for j in range(2)],
    }[combine]
    return f"""
WITH RECURSIVE {graphs._ROLES}, {graphs._SEEN}, edges AS ({graphs._AST} UNION ALL ({graphs._NCS}) UNION ALL ({graphs._DFG})), state AS (
    SELECT fn_id, node_id, CASE WHEN is_leaf THEN 1.0::DOUBLE ELSE 0 END AS h0, (node_id % 7) / CAST(7 AS DOUBLE) AS h1 FROM nodes
), sums AS (
    SELECT e.fn_id, dst, etype, count(*) AS w, sum(h0) AS x0, sum(h1) AS x1 FROM edges e JOIN state s ON s.fn_id = e.fn_id AND s.node_id = e.src GROUP BY e.fn_id, dst, etype
), typed AS (
    SELECT fn_id, dst AS node_id, etype, {product(0)} AS m0, {product(1)} AS m1 FROM sums
)
SELECT fn_id, node_id, [{", ".join(cells)}] AS m FROM typed GROUP BY fn_id, node_id"""


ORACLE_SQL = {f"message_step{'' if c == 'sum' else '_' + c}": _step_sql(c) for c in ("sum", "mean", "max", "concat")} | {
    "conv_readout": _conv_sql("nodes"),
    "conv_readout_features": _conv_sql("features"),
    "conv_probabilities": _conv_sql("nodes", "round(1 / (1 + exp(-logit)), 6) AS prob, CAST(1 / (1 + exp(-logit)) >= 0.5 AS INTEGER) AS predicted"),
    "code_vectors": f"""
WITH {_HASHED}, bare AS (
    SELECT fn_id, node_id, subtree_end, CASE WHEN is_leaf THEN code WHEN subtree_end = node_id THEN type END AS token FROM nodes
), below AS (
    SELECT n.fn_id, n.node_id, {", ".join(f"avg(v.vector[{k + 1}]) AS a{k}" for k in range(DIM))} FROM nodes n
    JOIN bare l ON l.fn_id = n.fn_id AND l.subtree_end = l.node_id AND l.node_id BETWEEN n.node_id AND n.subtree_end JOIN vectors v ON v.token = l.token GROUP BY n.fn_id, n.node_id
)
SELECT n.fn_id, n.node_id, [{", ".join(f"round(coalesce(a{k}, 0), 6)" for k in range(DIM))}] AS code_feat FROM nodes n LEFT JOIN below b ON b.fn_id = n.fn_id AND b.node_id = n.node_id""",
    "node_features_zero": f"WITH {_HASHED} SELECT fn_id, node_id, coalesce(vector, [0.0::DOUBLE, 0, 0, 0]) AS code_feat FROM nodes LEFT JOIN vectors ON is_leaf AND token = code",
    "node_features_mean": f"""
WITH {_HASHED}, below AS (
    SELECT n.fn_id, n.node_id, {", ".join(f"avg(v.vector[{k + 1}]) AS a{k}" for k in range(DIM))} FROM nodes n
    JOIN nodes l ON l.fn_id = n.fn_id AND l.is_leaf AND l.node_id BETWEEN n.node_id AND n.subtree_end JOIN vectors v ON v.token = l.code GROUP BY n.fn_id, n.node_id
)
SELECT n.fn_id, n.node_id, [{", ".join(f"round(coalesce(a{k}, 0), 6)" for k in range(DIM))}] AS code_feat FROM nodes n LEFT JOIN below b ON b.fn_id = n.fn_id AND b.node_id = n.node_id""",
}
