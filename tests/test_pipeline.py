from __future__ import annotations

import json

import pytest

from lodestrata import cli
from lodestrata.config import load_config
from lodestrata.operators import artifacts
from lodestrata.plans import metrics, models, pipeline


def test_config_layers(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": [1, 2]}, "b": 2}))
    (tmp_path / "own.json").write_text(json.dumps({"extends": "base.json", "a": {"y": [3]}, "c": None}))
    assert load_config(str(tmp_path / "own.json")) == {"a": {"x": 1, "y": [3]}, "b": 2, "c": None}
    (tmp_path / "p.json").write_text(json.dumps({"extends": "q.json"}))
    (tmp_path / "q.json").write_text(json.dumps({"extends": "p.json"}))
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "p.json"))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))


STAGES = ["functions", "verdicts", "reasons", "nodes", "splits", "edges", "type_vocabulary", "token_vocabulary", "sequences", "word_vectors", "embedding_matrix", "featurizer", "samples", "metrics"]


@pytest.mark.parametrize("by,paper", [("random", False), ("commit", True)])
def test_prepare_resumes(spark, tmp_path, by, paper):
    out, source = str(tmp_path / "out"), "/root/testdata/sf0.001"
    made = pipeline.prepare(spark, source, out, {"data": {"split_by": by, "paper_split": paper}, "embedding": {"word2vec_dim": 6, "word2vec_epochs": 1}})
    assert made == STAGES
    assert pipeline.prepare(spark, source, out) == []
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    nodes, parts, info = read("nodes"), read("splits"), spark.read.parquet(f"{source}/parse_info.parquet")
    assert nodes.groupBy("fn_id").count().filter("count > 500").count() == 0
    kept = {r["fn_id"] for r in nodes.select("fn_id").distinct().collect()}
    unusable = {r["fn_id"] for r in info.filter("reason = 'parse' OR NOT has_function_definition OR error_bytes > 0.2 * total_bytes").collect()}
    assert kept and not kept & unusable
    # splits, samples, sequences and metrics are of the functions that have a kept tree
    assert {r["fn_id"] for r in parts.collect()} == {r["fn_id"] for r in read("samples").select("fn_id").collect()} == {r["fn_id"] for r in read("metrics").collect()} == kept
    assert {r["part"] for r in parts.select("part").distinct().collect()} <= ({"train", "val"} if paper else {"train", "val", "test"})
    assert sum(r["n"] for r in read("reasons").collect()) == read("functions").count()
    for r in read("samples").collect():
        assert r["num_nodes"] == len(r["code_feat"]) == len(r["type_ids"]) and {len(v) for v in r["code_feat"]} == {6}
        assert len(r["edges"].get("AST", [])) == r["num_nodes"] - 1
    assert pipeline.load_featurizer(spark, out)[2] == "zero" and pipeline.load_featurizer(spark, out)[0].count() > 0
    numbers = {r["token_id"]: r for r in read("embedding_matrix").collect()}
    assert set(numbers) == {0, 1} | {r["token_id"] for r in read("token_vocabulary").collect()} and numbers[0]["vector"] == [0.0] * 6
    known = {r["token"]: r["vector"] for r in read("word_vectors").collect()}
    assert all(r["trained"] == (r["token"] in known) and (not r["trained"] or r["vector"] == known[r["token"]]) for r in numbers.values())
    assert max(t for r in read("sequences").collect() for t in r["token_ids"]) <= max(numbers)


def test_verdicts_in_order(spark):
    functions = spark.createDataFrame([(i,) for i in range(6)], "fn_id bigint")
    parsed = spark.createDataFrame([(1, 30, 100, True, None), (2, 20, 100, True, None), (3, 0, 0, False, None), (4, 0, 10, True, None), (4, 0, 10, True, None)], "fn_id bigint, error_bytes int, total_bytes int, has_function_definition boolean, reason string")
    sizes = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 501), (5, 500)], "fn_id bigint, num_nodes bigint")
    got = {r["fn_id"]: r["reason"] for r in pipeline.verdicts(functions, parsed, sizes, 500, 0.2).collect()}
    assert got == {0: "empty", 1: "parse", 2: "kept", 3: "parse", 4: "size", 5: "kept"}
    assert {r["reason"] for r in pipeline.verdicts(functions, None, sizes, 500, 0.2).collect()} == {"empty", "kept", "size"}


def test_commands(spark, tmp_path, monkeypatch):
    source = "/root/testdata/sf0.001"
    monkeypatch.setattr(models, "ROUNDS", 3)
    monkeypatch.setattr(cli, "BASELINES", {k: cli.BASELINES[k] for k in ("metrics", "tokens")})
    assert cli.run(spark, "train_baselines", source, str(tmp_path)) == {}
    root = str(tmp_path / "models")
    assert 0 <= artifacts.load_threshold(spark, root, "tokens") <= 1 and artifacts.load_threshold(spark, root, "tokens", "nowhere") == 0.5
    assert {r["split"] for r in spark.read.parquet(f"{root}/tokens/combined/metrics").collect()} <= {"val", "test"}
    with pytest.raises(FileNotFoundError):
        artifacts.load_parameters(spark, root, "tokens")
    assert cli.run(spark, "train", source, str(tmp_path), {"training": {"epochs": 1}}) == {}
    assert len(artifacts.load_parameters(spark, root, "readout")) == 400 * 16 + 16 + 16 + 1 and spark.read.parquet(f"{tmp_path}/train").first()["model"] == "readout"
    with pytest.raises(ValueError):
        cli.run(spark, "nothing", source, str(tmp_path))
    monkeypatch.setitem(metrics.QUERIES, "class_weight", lambda *_: 1 / 0)
    assert list(cli.run(spark, "class_weight", source, str(tmp_path / "x"))) == ["class_weight"]
    assert spark.read.json(str(tmp_path / "x" / "failures")).first()["stage"] == "class_weight"
    assert cli.run(spark, "confusion_by_split", source, str(tmp_path / "x")) == {} and spark.read.parquet(str(tmp_path / "x" / "confusion_by_split")).count() > 0
