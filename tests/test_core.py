"""Core operators: registered queries against their SQL on the smallest data, goldens for control flow, brute force for metrics and splits."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodestrata import registry, session
from lodestrata.functions import patterns, texts
from lodestrata.operators import classifier_metrics, features, networks, ranking, readout, splits, training, trees
from lodestrata.plans import corpus, graphs, models
from lodestrata.sources import records
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    cur = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == Counter(tuple(plain(x) for x in r) for r in cur.fetchall())


@pytest.fixture(scope="session")
def trees_of(spark):
    """Nodes and all edges of the smallest data, by function."""
    nodes = trees.sized(trees.clean(spark.read.parquet(f"{DATA}/ast_nodes.parquet")))
    edges = trees.all_edges(nodes).collect()
    return {r["fn_id"] for r in nodes.select("fn_id").distinct().collect()}, edges


def test_edge_counts_and_metrics_agree(spark, trees_of):
    rows = graphs.edge_counts(spark, DATA).collect()
    counts = {(r["fn_id"], r["etype"]): r["n"] for r in rows}
    own = Counter((e["fn_id"], e["etype"]) for e in trees_of[1])
    assert all(counts[k] == n for k, n in own.items()) and {f for f, _ in counts} >= trees_of[0] and len(rows) % 7 == 0
    nodes = defaultdict(list)
    for r in trees.clean(spark.read.parquet(f"{DATA}/ast_nodes.parquet")).collect():
        nodes[r["fn_id"]].append(r)
    for r in graphs.function_metrics(spark, DATA).collect():
        mine = nodes[r["fn_id"]]
        around = [n for n in mine if n["type"] in trees.LOOPS + trees.BRANCHES]
        has = lambda *t: sum(n["type"] in t for n in mine)  # noqa: E731, B023
        assert r["num_nodes"] == len(mine) and r["num_ast_edges"] == counts[r["fn_id"], "AST"] and r["num_cfg_edges"] == counts[r["fn_id"], "CFG"]
        assert r["num_dfg_edges"] == sum(counts[r["fn_id"], k] for k in ("DFG_R", "DFG_W", "DFG_C"))
        assert (r["num_loops"], r["num_branches"]) == (has(*trees.LOOPS), has(*trees.BRANCHES)) and r["cyclomatic"] == len(around) + 1
        assert r["max_nesting"] == max(sum(a["node_id"] < n["node_id"] <= a["subtree_end"] for a in around) for n in mine)
        assert r["num_calls"] == has("call_expression") and r["num_pointers"] == has("pointer_declarator", "pointer_expression") and r["num_identifiers"] == has("identifier")
        assert r["num_alloc"] == sum(n["code"] in trees.ALLOCATORS for n in mine) and r["num_free"] == sum(n["code"] == "free" for n in mine)


def test_edges_stay_inside(spark):
    assert graphs.edge_bounds(spark, DATA).count() == 0


def test_one_step_along_all_types(spark, trees_of):
    nodes, vectors = models._hashed(spark, DATA)
    first = {(r["fn_id"], r["node_id"]): np.array(r["h"]) for r in models._initial(nodes, vectors, models.DIM, models.DIM).collect()}
    assert {len(h) for h in first.values()} == {2 * models.DIM} and len({tuple(h[models.DIM :]) for h in first.values()}) > 5
    w = features.random_weights(2 * models.DIM)
    expected = defaultdict(lambda: np.zeros(2 * models.DIM))
    for f, k, a, b in {tuple(e[c] for c in ("fn_id", "etype", "src", "dst")) for e in trees_of[1]}:
        i = trees.EDGE_TYPES.index(k)
        expected[f, b] += w["w"][i] @ first[f, a] + w["b"][i]
    got = {(r["fn_id"], r["node_id"]): r["m"] for r in models.message_step_all(spark, DATA).collect()}
    assert set(got) == set(expected) and all(np.allclose(got[k], expected[k], atol=1e-5) for k in got)


def held_out(spark, kept):
    rows = spark.read.parquet(f"{DATA}/raw_functions.parquet").filter("target IS NOT NULL AND split IN ('val', 'test')").collect()
    return {r["fn_id"]: (r["target"], r["split"]) for r in rows if r["fn_id"] in kept}


def test_models_score_every_held_out_function(spark, trees_of, monkeypatch):
    monkeypatch.setattr(models, "ROUNDS", 5)
    data, expected = models.Corpus(spark, DATA), held_out(spark, trees_of[0])
    scored = {
        "metrics": models.metrics_classifier_scores(spark, DATA), "tokens": models.token_classifier_scores(spark, DATA), "graph": models._graph_scores(data),
        "convolution": models._conv_scores(data, training.Settings(epochs=2))[0], "token_convolution": models._token_conv_scores(data, training.Settings(epochs=2))[0], "readout": models._readout_scores(data, training.Settings(epochs=2))[0], "recurrent": models._recurrent_scores(data, True, training.Settings(epochs=1))[0],
    }
    for name, df in scored.items():
        rows = df.collect()
        assert {r["fn_id"]: (r["label"], r["split"]) for r in rows} == expected and len(rows) == len(expected), name
        assert all(0 <= r["prob"] <= 1 for r in rows), name
    vectors = {r["fn_id"]: r for r in data.states(features.pooled_states).collect()}
    assert set(vectors) == trees_of[0] and {len(r["vector"]) for r in vectors.values()} == {4 * (models.CODE_DIM + models.TYPE_DIM)}


def test_ablation_has_every_type(spark):
    rows = models.edge_ablation(spark, DATA).collect()
    assert {r["edges"] for r in rows} == {"AST", "CFG", "NCS", "DFG_R", "DFG_W", "DFG_C", "all"} and len(rows) == 7


def test_samples_and_embedding(spark, trees_of):
    edges = {tuple(e[c] for c in ("fn_id", "etype", "src", "dst")) for e in trees_of[1]}
    for r in models.graph_samples(spark, DATA).collect():
        assert r["fn_id"] in trees_of[0] and len(r["code_feat"]) == len(r["type_ids"]) == r["num_nodes"]
        assert {(r["fn_id"], k, a, b) for k, es in r["edges"].items() for a, b in es} == {e for e in edges if e[0] == r["fn_id"]}
    rows = {r["token_id"]: r for r in models.embedding_matrix(spark, DATA).collect()}
    assert sorted(rows) == list(range(len(rows))) and not any(rows[0]["vector"]) and any(rows[1]["vector"])
    noise = np.array([r["vector"] for k, r in rows.items() if k and not r["trained"]])
    assert abs(noise.mean()) < 0.01 and abs(noise.std() - 0.1) < 0.01


def test_leakage_is_measured_on_two_splits(spark):
    row = models.leakage_refit(spark, DATA).collect()
    assert len(row) == 1 and row[0]["accuracy_gap"] == pytest.approx(row[0]["accuracy_random"] - row[0]["accuracy_commit"], abs=0.01)


def tree(spec):
    """Rows of a tree given as (type, code or children)."""
    rows = []

    def add(node, parent):
        kind, rest = node if isinstance(node, tuple) else (node, "")
        k = len(rows)
        rows.append([kind, rest if isinstance(rest, str) else kind, parent])
        for c in rest if isinstance(rest, list) else []:
            add(c, k)
        return k

    add(("function_definition", [("compound_statement", spec)]), None)
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def flow(spec):
    types, codes, parents = tree(spec)
    return types, sorted(trees.flow_of(types, codes, parents))


E, RET, BRK, CONT, COND = "expression_statement", "return_statement", "break_statement", "continue_statement", "parenthesized_expression"


# node 0 is the function, 1 its block; statements are numbered from 2 in pre-order
@pytest.mark.parametrize(
    "spec,edges",
    [
        ([E, E, RET, E], [(2, 3), (3, 4)]),
        ([("compound_statement", []), E], []),
        ([("if_statement", ["if", COND, E]), E], [(4, 5), (4, 6), (5, 6)]),
        ([("if_statement", ["if", COND, E, ("else_clause", ["else", E])]), E], [(4, 5), (4, 8), (5, 9), (8, 9)]),
        ([("if_statement", ["if", COND, E, ("else_clause", ["else", ("compound_statement", [])])]), E], [(4, 5), (5, 9)]),
        ([("if_statement", ["if", COND, ("compound_statement", [])]), E], [(4, 6)]),
        ([("while_statement", ["while", COND, ("compound_statement", [E, BRK, CONT])]), E], [(4, 6), (4, 9), (6, 7), (7, 9), (8, 4)]),
        ([("for_statement", ["for", "declaration", "binary_expression", "update_expression", E]), E], [(4, 5), (5, 6), (6, 7), (6, 8), (7, 6)]),
        ([("for_statement", ["for", E]), E], [(2, 4), (2, 5), (4, 2)]),
        ([("for_statement", ["for"]), E], []),
        ([("do_statement", ["do", ("compound_statement", [E, CONT]), "while", COND]), E], [(5, 6), (6, 8), (8, 5), (8, 9)]),
        ([("switch_statement", ["switch", COND, ("compound_statement", [("case_statement", ["case", "number_literal", E]), ("case_statement", ["default", E, BRK])])]), E], [(4, 9), (4, 12), (9, 12), (12, 13), (13, 14)]),
        ([("switch_statement", ["switch", COND, ("compound_statement", [])]), E], [(4, 6)]),
        ([("labeled_statement", [("statement_identifier", "again"), E]), ("goto_statement", ["goto", ("statement_identifier", "again")]), E], [(2, 4), (4, 5), (5, 2)]),
        ([("goto_statement", ["goto", ("statement_identifier", "nowhere")]), E], []),
        ([("while_statement", ["while", COND, ("while_statement", ["while", COND, BRK])]), E], [(4, 7), (4, 9), (7, 4), (7, 8), (8, 4)]),
    ],
)
def test_control_flow_goldens(spec, edges):
    # a case's first child that isn't a statement is its label; in 'default' without label the first other one
    types, got = flow(spec)
    assert got == sorted(edges), list(enumerate(types))


def scored_rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice("abc"), rng.choice([0, 1, 1, None]) if k else 1, rng.choice([0.1, 0.5, 0.50001, rng.random(), None, float("nan")]), "val") for i in range(n) for k in [rng.random() > 0.02]]


def test_auc_and_threshold_against_brute_force(spark):
    rows = scored_rows()
    df = spark.createDataFrame(rows, "fn_id bigint, project string, label int, prob double, split string")
    aucs = {r["project"]: r["auc"] for r in classifier_metrics.auc(df, ["project"]).collect()}
    best = {o: {r["project"]: r["threshold"] for r in classifier_metrics.best_threshold(df, ["project"], o).collect()} for o in ("f1_guarded", "f1", "accuracy", "mcc")}
    by = defaultdict(list)
    for _, p, y, x, _ in rows:
        if y is not None and x is not None and x == x:
            by[p].append((x, y))
    for p, v in by.items():
        pos, neg = [x for x, y in v if y == 1], [x for x, y in v if y == 0]
        assert aucs[p] == pytest.approx(100 * sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
        u = sorted({x for x, _ in v})
        cand = sorted({0.5, *((a + b) / 2 for a, b in zip(u, u[1:]))})

        def measure(t, v=v):
            tp, fp = sum(x >= t and y == 1 for x, y in v), sum(x >= t and y == 0 for x, y in v)
            fn, tn = sum(x < t and y == 1 for x, y in v), sum(x < t and y == 0 for x, y in v)
            root = ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5
            return {"f1": 2 * tp / max(1, 2 * tp + fp + fn), "accuracy": (tp + tn) / len(v), "mcc": (tp * tn - fp * fn) / root if root else 0.0}

        for o in ("f1", "accuracy", "mcc"):
            assert measure(best[o][p])[o] == pytest.approx(max(measure(t)[o] for t in cand))
        feasible = [t for t in cand if measure(t)["accuracy"] >= measure(0.5)["accuracy"] - 1e-9]
        assert measure(best["f1_guarded"][p])["f1"] == pytest.approx(max(measure(t)["f1"] for t in feasible))


def test_one_class_and_empty_scores(spark):
    schema = "fn_id bigint, project string, label int, prob double, split string"
    one = spark.createDataFrame([(i, "a", 1, 0.9, "val") for i in range(5)], schema)
    assert classifier_metrics.auc(one, ["project"]).first()["auc"] == 50.0
    assert classifier_metrics.best_threshold(one, ["project"]).first()["threshold"] == 0.5
    empty = spark.createDataFrame([], schema)
    assert classifier_metrics.best_threshold(empty, ["project"]).count() == 0
    total = classifier_metrics.project_metrics(empty).collect()
    assert [r["accuracy"] for r in total] in ([0.0], [])
    with pytest.raises(ValueError):
        classifier_metrics.best_threshold(one, ["project"], "other")


def test_quantile_candidates(spark):
    rng = random.Random(4)
    probs = [rng.random() for _ in range(700)]
    df = spark.createDataFrame([(i, "a", i % 2, p, "val") for i, p in enumerate(probs)], "fn_id bigint, project string, label int, prob double, split string")
    got = sorted(r["threshold"] for r in classifier_metrics.candidate_sweep(df, ["project"]).collect())
    u = np.quantile(np.unique(probs), np.linspace(0, 1, 512))
    assert np.allclose(got, np.unique(np.concatenate([[0.5], (u[:-1] + u[1:]) / 2])))


def test_spread_rank_is_row_number(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", None, "y"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, k string").withColumn("h", F.md5(F.col("id").cast("string")))
    got = ranking.spread_rank(df, ["k"], ["h", "id"], ranking.hash_cell("h")).collect()
    for k in ("x", None, "y"):
        own = sorted((r["h"], r["id"], r["rank"]) for r in got if r["k"] == k)
        assert [r[2] for r in own] == list(range(1, len(own) + 1))
    assert len(got) == 500


def test_spread_sums_are_running_sums(spark):
    rng = random.Random(19)
    rows = [(i, rng.choice(["x", None, "y"]), rng.randint(-5, 500) / 4, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, k string, x double, v bigint")
    cell = ranking.number_cell(F.col("x"), 0, 100, 16)
    got = ranking.spread_sums(df, ["k"], ["x", "id"], cell, ["v"]).collect()
    after = {r["id"]: r["next"] for r in ranking.spread_next(df, ["k"], "x", cell).collect()}
    assert len(got) == len(after) == 400
    for r in got:
        own = sorted((x, i, v) for i, k, x, v in rows if k == r["k"])
        assert r["before_v"] == sum(v for x, i, v in own if (x, i) < (r["x"], r["id"]))
    for key in ("x", None, "y"):
        own = sorted((x, i) for i, k, x, _ in rows if k == key)
        assert sorted((x, after[i]) for x, i in own if after[i] is not None) == sorted(zip([x for x, _ in own], [x for x, _ in own[1:]]))


def test_splits_hold_their_invariants(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, f"c{rng.randint(0, 60)}" if rng.random() < 0.8 else rng.choice(["", None]), f"p{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "fn_id bigint, target int, commit_id string, project string")
    parts = Counter((r["target"], r["part"]) for r in splits.stratified(df, "target", "fn_id").collect())
    assert parts == {(t, p): n for t in (0, 1) for p, n in (("train", 112), ("val", 18), ("test", 20))}
    got = splits.group_disjoint(df, "commit_id", "fn_id").collect()
    where = defaultdict(set)
    for r in got:
        where[r["commit_id"] or r["fn_id"]].add(r["part"])
    assert len(got) == 300 and all(len(v) == 1 for v in where.values()) and {r["part"] for r in got} == {"train", "val", "test"}
    sub = splits.imbalance(df, "target", "fn_id", 0.1).collect()
    assert sum(r["target"] for r in sub) == 17 and len(sub) == 167
    assert splits.group_disjoint(df.limit(0), "commit_id", "fn_id").count() == 0


def one_pass(sizes, batch_size, max_nodes):
    """Sizes in ascending order, cut by one pass."""
    batches, own = [], []
    for size in sorted(sizes):
        if own and (len(own) + 1 > batch_size or (len(own) + 1) * size > max_nodes):
            batches.append(own)
            own = []
        own.append(size)
    return [*batches, own] if own else batches


@pytest.mark.parametrize("batch_size,max_nodes", [(128, 12_000), (5, 100), (1, 10), (7, 3)])
def test_size_batches_are_those_of_one_pass(spark, batch_size, max_nodes):
    rng = random.Random(7)
    rows = [(i, rng.choice([3, 4, 40, 45, 46, 500, 9000, 20000, None, 0, -1])) for i in range(400)]
    got = splits.size_batches(spark.createDataFrame(rows, "id bigint, size int"), "id", "size", batch_size, max_nodes).collect()
    by = defaultdict(list)
    for r in got:
        by[r["batch_id"]].append(r["size"])
    assert sorted(r["id"] for r in got) == [i for i, s in rows if s and s > 0]
    assert [sorted(by[k]) for k in sorted(by)] == one_pass([s for _, s in rows if s and s > 0], batch_size, max_nodes) and sorted(by) == list(range(len(by)))


def test_cuts_of_batches():
    rng = random.Random(8)
    for _ in range(300):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(0, 40))]
        batch_size, max_nodes = rng.randint(1, 6), rng.randint(1, 30)
        by = defaultdict(list)
        for size, batch, fit, first, each in splits.cut_batches(sorted(Counter(sizes).items()), batch_size, max_nodes):
            for r in range(Counter(sizes)[size]):
                by[batch if r < fit else first + (r - fit) // each].append(size)
        assert [by[k] for k in sorted(by)] == one_pass(sizes, batch_size, max_nodes)


def test_no_commit_spans_parts_of_the_given_data(spark):
    """Whatever white space or letter case its name is written with."""
    raw = spark.read.parquet("/root/testdata/sf0.01/raw_functions.parquet").collect()
    names = {r["fn_id"]: (r["commit_id"] or "").strip().lower() for r in raw}
    assert any((r["commit_id"] or "").strip() != (r["commit_id"] or "").strip(" ") for r in raw)
    parts, of = defaultdict(set), {}
    for r in corpus.commit_split(spark, "/root/testdata/sf0.01").collect():
        of[r["fn_id"]] = r["part"]
        if names[r["fn_id"]]:
            parts[names[r["fn_id"]]].add(r["part"])
    assert all(len(p) == 1 for p in parts.values())
    assert set(of) == {r["fn_id"] for r in raw if (r["func"] or "").strip()}
    seen = {names[r["fn_id"]] for r in raw if r["split"] == "train" and (r["func"] or "").strip()}
    held = corpus.unseen_commit_holdout(spark, "/root/testdata/sf0.01").collect()
    assert held and all(names[r["fn_id"]] and names[r["fn_id"]] not in seen for r in held)


def test_white_space_of_any_kind(spark):
    spaces = ["", " ", "\t\n", "\u00a0", "\u2003\u3000", "\x1c", "\u200b"]
    rows = [(i, s, f"{s} Na me{s}") for i, s in enumerate(spaces)] + [(90, None, None)]
    got = {r["i"]: r for r in spark.createDataFrame(rows, "i int, s string, n string").select("i", texts.has_text("s").alias("t"), texts.name_of("n").alias("n")).collect()}
    assert [got[i]["t"] for i in range(len(spaces))] == [bool(s.strip()) for s in spaces] and not got[90]["t"]
    assert [got[i]["n"] for i in range(len(spaces))] == [f"{s} Na me{s}".strip().lower() for s in spaces] and got[90]["n"] == ""


def test_holdout_of_val_where_there_is_no_test(spark):
    rows = [(1, "val", 1, "a"), (2, "val", 1, "b"), (3, "train", 1, "b"), (4, "val", 0, "c"), (5, "val", 1, " "), (6, "val", 1, None), (7, "val", 1, "d"), (8, "val", 1, "d")]
    df = spark.createDataFrame(rows, "fn_id bigint, split string, target int, commit_id string").withColumn("project", F.lit("p"))
    held = lambda d, k: {r["fn_id"] for r in splits.unseen_group_holdout(d, "split", "target", "commit_id", "project", "fn_id", k).collect()}
    assert held(df, 9) == {1, 7, 8} and len(held(df, 2)) == 2
    assert held(df.unionByName(spark.createDataFrame([(9, "test", 1, "e", "p")], df.schema)), 9) == {9}
    assert held(df.limit(0), 9) == set()


def test_two_way_splits(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, f"c{i // 4}") for i in range(103)], "fn_id bigint, target boolean, commit_id string").withColumn("target", F.col("target").cast("int"))
    for config in ({"paper_split": True}, {"paper_split": True, "split_by": "commit"}):
        got = splits.split_rows(df, config).collect()
        assert len(got) == 103 and {r["part"] for r in got} == {"train", "val"}
    pair = Counter((r["target"], r["part"]) for r in splits.stratified_pair(df, "target", "fn_id").collect())
    assert pair == {(1, "train"): 26, (1, "val"): 9, (0, "train"): 51, (0, "val"): 17}
    assert Counter(r["part"] for r in splits.split_rows(df, {}).collect()).keys() == {"train", "val", "test"}
    with pytest.raises(ValueError):
        splits.split_rows(df, {"split_by": "other"})


def test_roles_below_many_wrappers(spark):
    """declaration > wrapper > ... > identifier writes at any depth; below a call it reads."""
    rows = []
    for fn, (top, depth) in enumerate([("declaration", d) for d in (0, 1, 2, 8, 9, 31)] + [("call_expression", d) for d in (0, 3, 9)]):
        kinds = [top, *["pointer_declarator" if k % 2 else "array_declarator" for k in range(depth)], "identifier"]
        rows += [(fn, k, t, "x" if t == "identifier" else t, k, 99, t == "identifier", k - 1 if k else None, len(kinds) - 1) for k, t in enumerate(kinds)]
    rows += [(50, 0, "pointer_declarator", "p", 0, 9, False, None, 1), (50, 1, "identifier", "x", 1, 2, True, 0, 1)]
    nodes = spark.createDataFrame(rows, "fn_id bigint, node_id int, type string, code string, start_byte int, end_byte int, is_leaf boolean, parent int, subtree_end int")
    got = {r["fn_id"]: r["role"] for r in trees.identifiers(nodes).collect()}
    assert got == {0: "write", 1: "write", 2: "write", 3: "write", 4: "write", 5: "write", 6: "read", 7: "read", 8: "read", 50: "write"}


def test_edges_out_of_bounds(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(4)] + [(2, 0)], "fn_id bigint, node_id int")
    edges = [(1, "AST", 0, 1), (1, "CFG", 0, 4), (1, "CFG", 9, 9), (1, "NCS", -1, 2), (2, "DFG_R", 0, 1), (3, "AST", 0, 0), (1, "OTHER", 0, 1), (1, None, 0, 1)]
    got = {(r["fn_id"], r["etype"]): r["outside"] for r in trees.edges_outside(spark.createDataFrame(edges, "fn_id bigint, etype string, src int, dst int"), nodes).collect()}
    assert got == {(1, "CFG"): 3, (1, "NCS"): 1, (2, "DFG_R"): 1, (3, "AST"): 2, (1, "OTHER"): 2, (1, None): 2}


def test_vocabulary_by_first_appearance(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(5000), k, rng.choice([None, *"abcdefghij"]) and f"t{rng.randrange(900)}") for k in range(4000)]
    got = {r["term"]: r["id"] for r in trees.vocabulary(spark.createDataFrame(rows, "fn_id bigint, node_id int, t string"), "t", ["fn_id", "node_id"], 2, "id").collect()}
    assert got == {t: k for k, t in enumerate(dict.fromkeys(t for *_, t in sorted(rows, key=lambda r: r[:2]) if t is not None), 2)}
    assert trees.vocabulary(spark.createDataFrame([], "fn_id bigint, node_id int, t string"), "t", ["fn_id", "node_id"], 2, "id").count() == 0


def test_states_of_graphs(spark):
    rng = np.random.default_rng(8)
    dim, graphs_ = 3, {1: [4, 0, 2], 2: [7], 3: [1, 5]}
    edges = [(1, "A", 0, 4), (1, "A", 0, 4), (1, "B", 4, 2), (1, "A", 0, 9), (3, "B", 1, 5), (3, "C", 5, 1)]
    h = {(g, n): rng.normal(0, 1, dim) for g, ns in graphs_.items() for n in ns}
    state = spark.createDataFrame([(g, n, v.tolist()) for (g, n), v in h.items()], "fn_id bigint, node_id int, h array<double>")
    w = features.random_weights(dim, ["A", "B"])
    got = {r["fn_id"]: r for r in features.graph_states(state, spark.createDataFrame(edges, "fn_id bigint, etype string, src int, dst int"), dim, 2, w).collect()}
    for g, ns in graphs_.items():
        ns = sorted(ns)
        rows = sorted({("AB".index(k), ns.index(a), ns.index(b)) for f, k, a, b in edges if f == g and k in "AB" and a in ns and b in ns})
        first = np.array([h[g, n] for n in ns])
        last = features.propagate(first, np.array(rows, np.int64).reshape(-1, 3), w, 2)
        assert got[g]["nodes"] == len(ns) and np.allclose(got[g]["vector"], features.all_states(last, first))


@pytest.mark.parametrize("net,dim", [(networks.TokenConvolution(3, 4, (1, 2, 3)), 3), (networks.CompositeReadout(2, 3, 4, 3, 2), 5), (networks.MemorySequence(2, 3), 2), (networks.MemorySequence(2, 2, 2, True), 2), (training.SummedPerceptron(3, 4, 0.5), 3)])
def test_gradients_of_networks(net, dim):
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 4, 7):
        flat, x, label = rng.normal(0, 0.5, sum(int(np.prod(s)) for s in net.shapes)), rng.normal(0, 1, (n, dim)), n % 2
        loss, g = net.gradient(x, label, net.unpack(flat), 2.0)
        step = 1e-6
        for k in range(len(flat)):
            moved = flat.copy()
            moved[k] += step
            assert (net.gradient(x, label, net.unpack(moved), 2.0)[0] - loss) / step == pytest.approx(g[k], abs=2e-3), (n, k)


def test_composite_readout_equals_the_relational_one():
    """Its branches respond like the fixed filters of ``conv_over_nodes``."""
    rng = np.random.default_rng(12)
    net = networks.CompositeReadout(3, 2, 4, 3, 2)
    params = net.unpack(rng.normal(0, 1, sum(int(np.prod(s)) for s in net.shapes)))
    for n in range(1, 9):
        x = rng.normal(0, 1, (n, 5))
        w = {"first": params[0].T, "b1": params[1], "second": params[2].T, "b2": params[3]}
        z = conv_by_hand(x, w)
        assert np.allclose(net._branch(x, params[:8])[0], np.maximum(z @ params[4] + params[5], 0) @ params[6] + params[7])


@pytest.mark.parametrize("net", [networks.TokenConvolution(2, 4, (2, 3)), networks.CompositeReadout(1, 1, 4, 4, 2), networks.MemorySequence(2, 6, 1, True)])
def test_networks_learn_an_order(spark, net):
    """Whether a rise or a fall stands somewhere in a row; sums over places can't tell."""
    rng = np.random.default_rng(13)
    rows = []
    for i in range(240):
        x = rng.normal(0, 0.2, (rng.integers(6, 12), 2))
        at, label = rng.integers(0, len(x) - 1), i % 2
        x[at], x[at + 1] = ([-1.5, 1.5], [1.5, -1.5]) if label else ([1.5, -1.5], [-1.5, 1.5])
        rows.append((i, label, "train" if i % 5 else "val", x.ravel().tolist()))
    data = spark.createDataFrame(rows, "fn_id bigint, label int, split string, states array<double>")
    _, history = training.train(data, 2, training.Settings(epochs=20, rate=0.05, patience=20), net=net)
    assert max(history.auc) > 90 and history.loss[-1] < history.loss[0]


def test_training_goes_on_where_it_stopped(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, "train" if i % 3 else "val", (rng.normal(0, 1, (2, 2)) + i % 2).ravel().tolist()) for i in range(60)]
    data = spark.createDataFrame(rows, "fn_id bigint, label int, split string, states array<double>")
    whole, history = training.train(data, 2, training.Settings(hidden=3, epochs=4, patience=9))
    training.train(data, 2, training.Settings(hidden=3, epochs=2, patience=9), str(tmp_path / "c"))
    again, resumed = training.train(data, 2, training.Settings(hidden=3, epochs=4, patience=9), str(tmp_path / "c"))
    assert np.allclose(whole, again) and np.allclose(history.loss, resumed.loss) and len(resumed.loss) == 4
    s = training.Settings.of_config({"training": {"lr": 0.5, "class_weighting": True, "epochs": 7}, "model": {"mlp_hidden": 9}}, spark.createDataFrame([(1,), (0,), (0,)], "label int"))
    assert (s.rate, s.hidden, s.epochs, s.positive_weight) == (0.5, 9, 7, 2.0) and training.Settings.of_config({}, epochs=0).epochs == training.Settings().epochs


def test_patterns(spark):
    texts = ["free(p); p->x = 1;", "free(p); q = 1;", "x = malloc(3);", "x = malloc(3); if (x == NULL) return;", "a[i <= n]", "printf(x)", 'printf("%s", x)', "strcpy(a, b)", "ok()", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", patterns.memory_flaw(F.col("t")).alias("m"), patterns.risky_call(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r["m"] for r in rows] == [1, 0, 1, 0, 1, 0, 0, 0, 0, 0]
    assert [r["r"] for r in rows] == [0, 0, 0, 0, 0, 1, 0, 1, 0, 0]


def test_record_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"code": "int f;", "label": 1, "repo": "x"}\n\n{"func": "", "function": "g", "target": 0, "commit_id": null}\n{"target": 1}\n')
    got = sorted(map(tuple, records.resolve_aliases(records.read_records(spark, str(tmp_path / "a.jsonl"))).collect()))
    assert got == [("g", 0, "unknown", "", "", ""), ("int f;", 1, "x", "", "", "")]
    (tmp_path / "b.json").write_text('{"data": [{"func": "a", "target": true}, {"func": "b", "target": "0"}]}')
    assert sorted(r["target"] for r in records.acquire(spark, {"path": str(tmp_path / "b.json")}).collect()) == [0, 1]
    (tmp_path / "c.csv").write_text('func,target\n"int f() {\n ""x"" }",1\n')
    assert records.resolve_aliases(records.read_records(spark, str(tmp_path / "c.csv"))).first()["func"] == 'int f() {\n "x" }'
    records.write_records(spark.createDataFrame([("f", 1)], "func string, target int"), str(tmp_path / "d.jsonl"))
    assert records.read_records(spark, str(tmp_path / "d.jsonl")).count() == 1
    with pytest.raises(ValueError):
        records.read_records(spark, "x.txt")
    with pytest.raises(ValueError):
        records.acquire(spark, {"source": "other"})
    release = spark.createDataFrame([("f", True, " ALPHA", "1"), ("f", False, "beta", "2"), (" ", True, "x", "3")], "func string, target boolean, project string, commit_id string")
    release.coalesce(1).write.parquet(str(tmp_path / "r.parquet"))
    got = records.acquire(spark, {"source": "release", "paths": [str(tmp_path / "r.parquet")], "projects": ["alpha"]}).collect()
    assert [(r["func"], r["target"], r["project"]) for r in got] == [("f", 1, "alpha")]


def test_readout_gradient_and_training(spark):
    rng = np.random.default_rng(3)
    dim, s = 3, training.Settings(hidden=4, epochs=12, rate=0.1, scale=1.0)
    flat = rng.normal(0, 1, dim * 4 + 4 + 4 + 1)
    x = rng.normal(0, 1, (5, dim))
    loss, g = training.gradient(x, 1, training.unpack(flat, dim, 4), 0.5, 2.0)
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up = training.gradient(x, 1, training.unpack(flat + step, dim, 4), 0.5, 2.0)[0]
        assert (up - loss) / 1e-6 == pytest.approx(g[k], abs=1e-3)
    rows = []
    for i in range(120):
        y = i % 2
        rows.append((i, y, "train" if i % 3 else "val", (rng.normal(0, 1, (rng.integers(1, 6), dim)) + (y * 2 - 1)).ravel().tolist()))
    graphs = spark.createDataFrame(rows, "fn_id bigint, label int, split string, states array<double>")
    best, history = training.train(graphs, dim, s)
    assert history.loss[-1] < history.loss[0] and max(history.auc) > 85 and history.auc[history.best] == max(history.auc)
    assert training.predict(graphs, best, dim, s).count() == 120


def test_message_forms_agree(spark):
    """The relational step and the numpy step give the same sums; a permutation of node numbers changes nothing."""
    rng = np.random.default_rng(4)
    dim, n = 3, 7
    w = features.random_weights(dim, ["A", "B"])
    h = rng.normal(0, 1, (n, dim))
    edges = sorted({(int(rng.integers(0, 2)), int(rng.integers(0, n)), int(rng.integers(0, n))) for _ in range(20)})
    m = np.zeros((n, dim))
    for k, a, b in edges:
        m[b] += h[a] @ w["w"][k].T + w["b"][k]
    state = spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(h)], "fn_id bigint, node_id int, h array<double>")
    rows = spark.createDataFrame([(1, "AB"[k], a, b) for k, a, b in edges], "fn_id bigint, etype string, src int, dst int")
    got = features.message_step(state, rows, {"A": (w["w"][0], w["b"][0]), "B": (w["w"][1], w["b"][1])}).collect()
    for r in got:
        assert np.allclose(r["m"], m[r["node_id"]])
    assert {r["node_id"] for r in got} == {b for *_, b in edges}
    order = rng.permutation(n)
    moved = np.array([(k, order[a], order[b]) for k, a, b in edges])
    again = np.empty_like(h)
    again[order] = h
    assert np.allclose(features.propagate(again, moved, w, 3)[order], features.propagate(h, np.array(edges), w, 3))


def conv_by_hand(v, w):
    """The responses of one graph's node vectors, by loops."""
    n, width = v.shape
    v = np.concatenate([np.zeros((1, width)), v, np.zeros((1, width))])
    first = [np.maximum(w["first"] @ v[i : i + 3].ravel() + w["b1"], 0) for i in range(n)]
    pooled = [np.max(first[i : i + 3], axis=0) for i in range(0, n, 2) if i + 1 < max(n, 4)]
    return np.max([np.maximum(w["second"] @ p + w["b2"], 0) for p in pooled], axis=0)


@pytest.mark.parametrize("width", [1, 3])
def test_convolution_along_nodes(spark, width):
    rng = np.random.default_rng(2)
    graphs = {n: rng.normal(0, 1, (n, width)) for n in range(1, 9)}
    w = readout.branch_weights(width, 3, rng)
    rows = [(n, k * 10, v.tolist(), "x") for n, vs in graphs.items() for k, v in enumerate(vs)]
    states = spark.createDataFrame(rows, "fn_id long, node_id int, v array<double>, place string")
    got = {r["fn_id"]: r["z"] for r in readout.conv_over_nodes(states, width, w).collect()}
    assert set(got) == set(graphs)
    for n, v in graphs.items():
        assert np.allclose(got[n], conv_by_hand(v, w))
    assert readout.conv_over_nodes(states.limit(0), width, w).count() == 0


def test_convolution_reads_null_vectors_as_zeros(spark):
    w = readout.branch_weights(3, 2, np.random.default_rng(4))
    rows = [(1, 0, [1.0, -1.0, 2.0]), (1, 1, None), (2, 0, [1.0, -1.0, 2.0]), (2, 1, [0.0, 0.0, 0.0])]
    for f in (readout.conv_over_nodes, readout.conv_over_features):
        got = {r["fn_id"]: r["z"] for r in f(spark.createDataFrame(rows, "fn_id long, node_id int, v array<double>"), 3, w | ({"first": w["first"][:, :3]} if f is readout.conv_over_features else {})).collect()}
        assert got[1] == got[2]


@pytest.mark.parametrize("net", [networks.TokenConvolution(3, 5, (1, 3, 4)), networks.MemorySequence(3, 4), networks.MemorySequence(3, 3, 2, True)])
def test_batches_of_records_are_sums_over_them(net):
    rng = np.random.default_rng(21)
    params = net.unpack(rng.normal(0, 0.5, sum(int(np.prod(s)) for s in net.shapes)))
    sizes, table = rng.integers(1, 9, 150), rng.normal(0, 1, (20, 3))
    numbers, labels = rng.integers(-1, 20, sizes.sum()), rng.integers(0, 2, 150)
    records = networks.Records(table, sizes, numbers)
    loss, g = net.gradients(records, labels, params, 2.0)
    own = [net.gradient(records[i], labels[i], params, 2.0) for i in range(150)]
    assert loss == pytest.approx(sum(x for x, _ in own)) and np.allclose(g, sum(x for _, x in own))
    assert np.allclose(net.logits(records, params), [net.logit(records[i], params) for i in range(150)])
    assert np.array_equal(records[3], [table[k] if k >= 0 else np.zeros(3) for k in numbers[records.bounds[3] : records.bounds[4]]])


def test_packs_hold_each_vector_once(spark, trees_of):
    """Sequences are the leaves' vectors in source order, though no vector is kept twice in a pack."""
    data = models.Corpus(spark, DATA)
    vectors = {r["token"]: np.float32(r["vector"]) for r in data.vectors.collect()}
    leaves = {r["fn_id"]: r["tokens"] for r in trees.leaf_tokens(data.nodes).collect()}
    packs, seen = models._token_packs(data, 40).collect(), set()
    for p in packs:
        table, at = np.float32(p["vectors"]).reshape(-1, models.CODE_DIM), 0
        assert len(np.unique(table, axis=0)) == len(table) < len(p["token"])
        for fn, n in zip(p["fn_id"], p["sizes"], strict=True):
            expected = [vectors.get(t, np.zeros(models.CODE_DIM)) for t in leaves[fn][:40]]
            assert np.array_equal(networks.rows_of(table, np.array(p["token"][at : at + n])), expected)
            seen.add(fn)
            at += n
    labelled = {r["fn_id"] for r in spark.read.parquet(f"{DATA}/raw_functions.parquet").filter("target IS NOT NULL AND split IS NOT NULL").collect()}
    assert seen == labelled & set(leaves) and sum(len(p["fn_id"]) for p in packs) == len(seen)


def test_packed_states_are_those_of_graphs(spark):
    data = models.Corpus(spark, DATA)
    first = models._initial(data.nodes, data.vectors.withColumn("vector", F.col("vector").cast("array<double>")), models.CODE_DIM, models.TYPE_DIM)
    for kinds in (trees.EDGE_TYPES, ["DFG_C"]):
        w = features.random_weights(models.CODE_DIM + models.TYPE_DIM, kinds)
        expected = {r["fn_id"]: r for r in features.graph_states(first, trees.all_edges(data.nodes), models.CODE_DIM + models.TYPE_DIM, weights=w).collect()}
        got = {r["fn_id"]: r for r in data.states(features.all_states, kinds).collect()}
        assert set(got) == set(expected)
        assert all(got[k]["nodes"] == expected[k]["nodes"] and np.allclose(got[k]["vector"], expected[k]["vector"], atol=1e-4) for k in got)


def test_unreached_nodes_share_their_states():
    rng = np.random.default_rng(31)
    token, kind, edges = np.array([1, -1, 1, 1, 2, -1, 1]), np.array([0, 0, 0, 1, 0, 0, 0]), np.array([[0, 2, 6], [0, 0, 6], [1, 5, 3]])
    kept, place = features.apart(edges[:, 2], token, kind)
    assert sorted(kept.tolist()) == [0, 1, 3, 4, 6] and place[0] == place[2] and place[1] == place[5] and place[6] not in place[:6]
    first, w = rng.normal(0, 1, (3, 4))[token] * (1 + kind[:, None]), features.random_weights(4, ["AST", "CFG"])
    less = features.propagate(first[kept], np.stack([edges[:, 0], place[edges[:, 1]], place[edges[:, 2]]], axis=1), w, 3)
    assert np.allclose(less[place], features.propagate(first, edges, w, 3))


def test_models_leave_no_copies_of_states(spark):
    """Training reads the written states; an ablation's vectors go when its scores are written."""
    data, spark_dir = models.Corpus(spark, DATA), session.work_dir(spark).removeprefix("file://")
    before = set(os.listdir(spark_dir))
    models._readout_scores(data, training.Settings(epochs=1))[0].collect()
    added = {n.split("-")[1] for n in set(os.listdir(spark_dir)) - before}
    assert "states" in added and not added & {"train", "val"}
    before = set(os.listdir(spark_dir))
    assert models.edge_ablation(spark, DATA).count() == 7
    assert not {n.split("-")[1] for n in set(os.listdir(spark_dir)) - before} & {"states", "training"}


def test_packs_go_through_networks_together(monkeypatch):
    """Short packs are joined up to the most places at once, each with its own vectors, and no record or label is left out."""
    rng, seen = np.random.default_rng(41), []
    packs = [(rng.integers(1, 5, n), rng.normal(0, 1, (k, 2)).astype(np.float32)) for n, k in ((3, 4), (2, 1), (4, 6), (1, 2))]
    tokens = [rng.integers(-1, len(table), sizes.sum()) for sizes, table in packs]
    columns = {"fn_id": [list(range(10 * i, 10 * i + len(s))) for i, (s, _) in enumerate(packs)], "label": [[i % 2] * len(s) for i, (s, _) in enumerate(packs)]}
    columns |= {"sizes": [s.tolist() for s, _ in packs], "token": [t.tolist() for t in tokens], "vectors": [v.ravel().tolist() for _, v in packs]}
    kinds = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float32())]
    batch = pa.record_batch([pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True)], names=list(columns))
    expected = [x for (sizes, table), t in zip(packs, tokens, strict=True) for x in np.split(networks.rows_of(table, t), np.cumsum(sizes)[:-1])]
    for places, parts in ((1000, 1), (int(packs[0][0].sum() + packs[1][0].sum()), None), (0, 4)):
        monkeypatch.setattr(training, "PLACES", places)
        got = list(training._records(iter([batch, batch.slice(0, 0)]), 2))
        assert parts in (len(got), None) and all(sum(r.sizes) <= places or len(r) <= 4 for _, r in got)
        assert all(np.array_equal(x, y) for x, y in zip([r[i] for _, r in got for i in range(len(r))], expected, strict=True))
        assert [f for own, _ in got for f in own["fn_id"].to_pylist()] == sum(columns["fn_id"], []) and [y for own, _ in got for y in own["label"].to_pylist()] == sum(columns["label"], [])
        seen.append(len(got))
    assert seen[0] < seen[1] <= seen[2]


def test_memory_cells_in_both_directions():
    """Both directions at once give the states of one cell after another, and the input's products are those of the different tokens alone."""
    rng = np.random.default_rng(42)
    sizes, gates, back = np.array([2, 5, 1, 3]), rng.normal(0, 1, (4, 2, 11, 3)), rng.normal(0, 1, (4, 2, 3, 3))
    steps, squash = networks.Steps(sizes), lambda x: 1 / (1 + np.exp(-x))
    states, _ = networks.memory_cells(gates.copy(), steps, back)
    for j, at in enumerate((steps.on, steps.back)):
        for first, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
            h = c = np.zeros(3)
            for k in range(first, first + n) if j == 0 else range(first + n - 1, first - 1, -1):
                i, f, o, new = (gates[g, j, at[k]] + h @ back[g, j] for g in range(4))
                c = squash(i) * np.tanh(new) + squash(f) * c
                h = squash(o) * np.tanh(c)
                assert np.allclose(states[j, at[k]], h)


def test_states_reach_their_files_without_shuffle_or_sort(spark):
    """The largest table isn't copied on its way; labels come with the packs, packs don't mix parts, and functions without label have no states."""
    plans, data = [], models.Corpus(spark, DATA)
    labelled = {r["fn_id"]: (r["target"], r["split"]) for r in spark.read.parquet(f"{DATA}/raw_functions.parquet").filter("target IS NOT NULL AND split IS NOT NULL").collect()}
    packs, fns = data.packs.select("part", "fn_id", "label", "split").collect(), {r["fn_id"] for r in data.nodes.select("fn_id").distinct().collect()}
    of = {f: p["part"] for p in packs for f in p["fn_id"]}
    assert of == {f: "none" if f not in labelled else s if (s := labelled[f][1]) in ("train", "val") else "rest" for f in fns} and sum(len(p["fn_id"]) for p in packs) == len(of)
    writer, whole = models.materialize, lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(models, "materialize", lambda df, name, **kw: plans.append((name, whole(df))) or writer(df, name, **kw))
        states = data.nodes_labelled
    assert plans[-1][0] == "states" and not any(x in plans[-1][1] for x in ("Join", "Sort", "Repartition", "Aggregate"))
    assert {r["fn_id"]: (r["label"], r["split"]) for r in states.select("fn_id", "label", "split").collect()} == {f: labelled[f] for f in fns & set(labelled)}
    assert {r["part"] for r in states.select("part").distinct().collect()} == {p for p in of.values() if p != "none"}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
