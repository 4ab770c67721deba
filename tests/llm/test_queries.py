"""The registered queries of the subpackage against their SQL, and the rest run, on the smallest data."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from lodestrata.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    cur = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    assert rows.count() >= 0 and rows.columns


def test_packing_keeps_every_node(spark):
    placed = queries.p2_pack(spark, DATA)
    total = {r["budget_name"]: r["n"] for r in placed.groupBy("budget_name").agg({"nodes": "sum"}).withColumnRenamed("sum(nodes)", "n").collect()}
    caps = {r["budget_name"]: r["max_nodes"] for r in spark.read.parquet(f"{DATA}/node_budgets.parquet").collect()}
    assert set(total) == set(caps) and len(set(total.values())) == 1
    full = placed.groupBy("budget_name", "container_id").agg({"nodes": "sum"}).collect()
    assert all(r["sum(nodes)"] <= caps[r["budget_name"]] for r in full)


@pytest.mark.parametrize("size,off", [("sf0.001", 0.02), ("sf0.01", 0.002), ("sf0.1", 0.001)])
def test_splits_follow_their_shares(spark, size, off):
    rows = {r["split"]: r for r in queries.p6_shares(spark, f"/root/testdata/{size}").collect()}
    total, positive = sum(r["rows"] for r in rows.values()), sum(r["positive"] for r in rows.values())
    for split, share in (("train", 0.75), ("val", 0.125), ("test", 0.125)):
        assert abs(rows[split]["rows"] / total - share) <= off
        assert abs(rows[split]["positive"] / rows[split]["rows"] - positive / total) < 4 * off + 0.01


def test_packing_holds_all_limits(spark):
    caps = {r["budget_name"]: r["max_nodes"] for r in spark.read.parquet(f"{DATA}/node_budgets.parquet").collect()}
    rows = queries.p2_limits(spark, DATA).collect()
    assert {r["budget_name"] for r in rows} == set(caps)
    for r in rows:
        assert r["most_segments"] <= queries.P2_SEGMENTS
        assert r["most_loss"] is None or r["most_loss"] <= caps[r["budget_name"]] * queries.P2_LOSS_PERMILLE // 1000
    assert any(r["most_segments"] == queries.P2_SEGMENTS for r in rows)
