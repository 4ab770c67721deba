"""Queries without SQL do the whole job: every row that must come out does."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import Word2Vec

from lodestrata import session
from lodestrata.operators import classifier_metrics, features, networks, training, trees
from lodestrata.plans import graphs, metrics, models

DATA = "/root/testdata/sf0.001"


def test_every_scored_function_has_a_prediction(spark):
    rows = models.predictions(spark, DATA).collect()
    scored = spark.read.parquet(f"{DATA}/scored.parquet").filter("prob IS NOT NULL").collect()
    assert Counter((r["fn_id"], r["prob"]) for r in rows) == Counter((r["fn_id"], r["prob"]) for r in scored)
    sizes = Counter(r["fn_id"] for r in trees.clean(spark.read.parquet(f"{DATA}/ast_nodes.parquet")).collect())
    assert {r["error"] for r in rows} == {None, "no graph"}
    for r in rows:
        n = sizes.get(r["fn_id"])
        assert r["num_nodes"] == n and (r["error"] is None) == (n is not None)
        assert all((r[k.lower()] is None) == (n is None) for k in trees.EDGE_TYPES)
        assert n is None or r["ast"] == r["rev_ast"] == n - 1


def test_word_vectors_are_trained_in_full(spark, monkeypatch):
    asked, fit = {}, Word2Vec.fit

    def recorded(self, *args):
        asked.update({p.name: v for p, v in self.extractParamMap().items()})
        return fit(self, *args)

    monkeypatch.setattr(Word2Vec, "fit", recorded)
    rows = {r["token"]: r["vector"] for r in models.word_vectors(spark, DATA).collect()}
    nodes = trees.sized(trees.clean(spark.read.parquet(f"{DATA}/ast_nodes.parquet")))
    counts = Counter(r["code"] for r in nodes.filter("is_leaf AND code IS NOT NULL").collect())
    assert set(rows) == {t for t, n in counts.items() if n >= 3}
    assert {len(v) for v in rows.values()} == {100}
    assert (asked["maxIter"], asked["windowSize"], asked["numPartitions"]) == (10, 5, spark.sparkContext.defaultParallelism)


def test_norms_of_all_edge_types(spark):
    nodes = trees.sized(trees.clean(spark.read.parquet(f"{DATA}/ast_nodes.parquet")))
    edges = {tuple(r) for r in trees.all_edges(nodes).select("fn_id", "etype", "src", "dst").collect()}
    edges |= {(r["fn_id"], k, r["node_id"], r["node_id"]) for r in nodes.collect() for k in trees.EDGE_TYPES}
    out = Counter((f, k, a) for f, k, a, _ in edges)
    got = {(r["fn_id"], r["etype"], r["src"], r["dst"]): r["norm"] for r in graphs.edge_norms_all(spark, DATA).collect()}
    assert got == {(f, k, a, b): 1 / out[f, k, a] for f, k, a, b in edges}
    assert any(k == "CFG" and a != b and norm < 1 for (_, k, a, b), norm in got.items())


def test_result_cells_hold_every_project(spark, tmp_path):
    rows = [(i, f"project{i % 7}", i % 2, i % 3 / 2, "test" if i % 5 else "val") for i in range(200)]
    spark.createDataFrame(rows, "fn_id bigint, project string, label int, prob double, split string").write.parquet(str(tmp_path / "scored.parquet"))
    got = {(r["method"], r["project"]): r["cell"] for r in metrics.result_cells(spark, str(tmp_path)).collect()}
    assert set(got) == {(s, p) for s in ("val", "test") for p in ["Combined", *[f"project{k}" for k in range(7)]]}
    own = [(y, x >= 0.5) for _, p, y, x, s in rows if s == "test" and p == "project3"]
    tp, wrong = sum(y == 1 and hit for y, hit in own), sum((y == 1) != hit for y, hit in own)
    assert got["test", "project3"] == f"{100 * (len(own) - wrong) / len(own):.2f}/{200 * tp / (2 * tp + wrong):.2f}"


def test_model_table_makes_states_once(spark, monkeypatch):
    """All three graph models read one table of states, and none of the intermediate tables stays behind."""
    made, states, trained = [], features.packed_states, models._trained_scores
    monkeypatch.setattr(features, "packed_states", lambda *args, **kw: made.append(1) or states(*args, **kw))
    monkeypatch.setattr(models, "_trained_scores", lambda rows, dim, s, net=None: trained(rows, dim, training.Settings(epochs=1), net))
    monkeypatch.setattr(models, "ROUNDS", 2)
    folder = session.work_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = models.model_table(spark, DATA).collect()
    assert len(made) == 1
    whole = {(r["model"], r["split"]): r["tp"] + r["tn"] + r["fp"] + r["fn"] for r in rows if r["project"] == classifier_metrics.COMBINED}
    kept = {r["fn_id"] for r in trees.sized(trees.clean(spark.read.parquet(f"{DATA}/ast_nodes.parquet"))).select("fn_id").distinct().collect()}
    labelled = spark.read.parquet(f"{DATA}/raw_functions.parquet").filter("target IS NOT NULL AND split IN ('val', 'test')").collect()
    of_split = Counter(r["split"] for r in labelled if r["fn_id"] in kept)
    assert whole == {(m, s): n for m in ("metrics", "tokens", "graph", "convolution", "readout", "token_convolution") for s, n in of_split.items()}
    assert all(r["headline"] == (r["split"] == ("val" if r["model"] in models.BASELINES else "test")) for r in rows)
    assert {n.split("-")[1] for n in set(os.listdir(folder)) - before if n.startswith("lodestrata-")} == {"measured"}


@pytest.mark.parametrize("net", [networks.CompositeReadout(2, 1, 4, 3, 2), training.SummedPerceptron(3, 4, 0.5)])
def test_graphs_side_by_side_are_sums_over_them(net):
    rng = np.random.default_rng(23)
    assert isinstance(net, networks.Batched)
    params = net.unpack(rng.normal(0, 0.5, sum(int(np.prod(s)) for s in net.shapes)))
    sizes, labels = rng.integers(1, 9, 150), rng.integers(0, 2, 150)
    records = networks.Records(rng.normal(0, 1, (sizes.sum(), 3)), sizes)
    loss, g = net.gradients(records, labels, params, 2.0)
    own = [net.gradient(records[i], labels[i], params, 2.0) for i in range(150)]
    assert loss == pytest.approx(sum(x for x, _ in own)) and np.allclose(g, sum(x for _, x in own))
    assert np.allclose(net.logits(records, params), [net.logit(records[i], params) for i in range(150)])


def test_states_as_bytes_are_those_as_lists():
    rng = np.random.default_rng(24)
    rows = [rng.normal(0, 1, 3 * n).astype(np.float32) for n in (2, 1, 5)]
    for column in (features.byte_column(rows), features.byte_column(rows).cast(pa.large_binary()), features.list_column(rows)):
        for i in range(3):
            records = features.written_states(column.slice(i), 3)
            assert records.sizes.tolist() == [len(r) // 3 for r in rows[i:]] and np.array_equal(records.table.ravel(), np.concatenate(rows[i:]))
    assert len(features.written_states(features.byte_column([]), 3)) == 0


def test_vectors_of_written_states_are_those_of_packs(spark):
    data = models.Corpus(spark, DATA)
    expected = {r["fn_id"]: r["vector"] for r in data.states(features.pooled_states).collect()}
    rows = features.pooled_rows(data.nodes_labelled.select("fn_id", "states", "label", "split"), 2 * (models.CODE_DIM + models.TYPE_DIM)).collect()
    assert rows and all(r["vector"] == expected[r["fn_id"]] for r in rows)
    assert {(r["fn_id"], r["label"], r["split"]) for r in rows} == {(r["fn_id"], r["target"], r["split"]) for r in spark.read.parquet(f"{DATA}/raw_functions.parquet").filter("target IS NOT NULL AND split IS NOT NULL").collect() if r["fn_id"] in expected}
