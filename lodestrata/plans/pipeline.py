"""Resumable preparation of a corpus: each stage is a written table, and a stage whose table is complete is skipped.

``python -m lodestrata.plans.pipeline IN OUT [--force] [--config FILE]`` reads ``IN/raw_functions.parquet``, ``IN/ast_nodes.parquet`` and,
if it is there, ``IN/parse_info.parquet``, and writes below OUT (L1, S9, S10, S13, D13):

| table | content |
|---|---|
| functions | first copies of texts with a label, one spelling of projects and commits |
| reasons | functions kept and dropped, by reason |
| nodes, edges | trees of the kept functions, and their edges of all types, repeated ones too |
| splits | train, val and test over the functions that have a kept tree |
| type_vocabulary, token_vocabulary | numbers of types, and of tokens of train |
| sequences | token numbers of each function, by split |
| word_vectors, embedding_matrix | trained token vectors, and one vector for each number of the token vocabulary |
| featurizer | how inner nodes are featurised, and the vectors' length |
| samples | featurised graphs, by split |
| metrics | the 15 metrics of each kept function |
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import load_config, merged
from lodestrata.operators import features, splits, trees
from lodestrata.operators.artifacts import complete
from lodestrata.plans import graphs, models
from lodestrata.plans.corpus import cleaned, first_copies
from lodestrata.session import table

DEFAULTS = {
    "data": {"max_nodes": trees.MAX_NODES, "max_error_share": 0.2, "train_split": 0.75, "val_split": 0.125, "paper_split": False, "split_by": "random", "projects": []},
    "embedding": {"word2vec_dim": models.CODE_DIM, "word2vec_min_count": 3, "word2vec_window": 5, "word2vec_epochs": 10, "internal_code": "zero"},
}


class Stages:
    """Tables below one folder; made once, read again afterwards."""

    def __init__(self, spark: SparkSession, out: str, force: bool = False):
        self.spark, self.out, self.force, self.made, self.failed = spark, out.rstrip("/"), force, [], {}

    def table(self, name: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.out}/{name}"
        if self.force or not complete(self.spark, path):
            make().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)

    def attempt(self, name: str, make: Callable[[], DataFrame]) -> None:
        """The same for a table that no other needs: if it fails, the reason is kept and the others go on."""
        try:
            self.table(name, make)
        except Exception as e:  # noqa: BLE001
            self.failed[name] = f"{type(e).__name__}: {e}"[:2000]

    def record_failures(self) -> None:
        """Write (stage, reason) of what failed, if anything did."""
        if self.failed:
            self.spark.createDataFrame(sorted(self.failed.items()), "stage string, reason string").coalesce(1).write.mode("overwrite").json(f"{self.out}/failures")


def verdicts(functions: DataFrame, parsed: DataFrame | None, sizes: DataFrame, max_nodes: int, max_error_share: float) -> DataFrame:
    """(fn_id, reason): 'kept', or the first reason to drop a function: no tree, unusable parse, too many nodes.

    ``parsed`` has the parser's figures, where there are any; functions it doesn't know have no unusable parse.
    """
    rows = functions.select("fn_id").join(sizes, "fn_id", "left")
    parse = F.lit(False)
    if parsed is not None:
        rows = rows.join(parsed.dropDuplicates(["fn_id"]).select("fn_id", "error_bytes", "total_bytes", "has_function_definition", "reason"), "fn_id", "left")
        share = F.when(F.col("total_bytes") > 0, F.col("error_bytes") / F.col("total_bytes")).otherwise(F.lit(0.0))
        parse = F.coalesce(~F.col("has_function_definition") | (share > max_error_share) | (F.col("reason") == "parse"), F.lit(False))
    return rows.select("fn_id", F.when(parse, "parse").when(F.col("num_nodes").isNull(), "empty").when(F.col("num_nodes") > max_nodes, "size").otherwise("kept").alias("reason"))


def prepare(spark: SparkSession, source: str, out: str, config: dict | None = None, force: bool = False) -> list[str]:
    """Make what isn't there yet; returns the names of the stages that ran."""
    config = merged(DEFAULTS, config or {})
    data, embedding = config["data"], config["embedding"]
    s = Stages(spark, out, force)
    raw = cleaned(table(spark, source, "raw_functions")).filter(F.col("target").isNotNull())
    if data["projects"]:
        raw = raw.filter(F.col("project").isin(data["projects"]))
    functions = s.table("functions", lambda: first_copies(raw).drop("split"))
    trees_ = trees.clean(table(spark, source, "ast_nodes"))
    has_info = complete(spark, f"{source}/parse_info.parquet") or os.path.exists(f"{source}/parse_info.parquet")
    sizes = trees_.groupBy("fn_id").agg(F.count(F.lit(1)).alias("num_nodes"))
    why = s.table("verdicts", lambda: verdicts(functions, table(spark, source, "parse_info") if has_info else None, sizes, data["max_nodes"], data["max_error_share"]))
    s.table("reasons", lambda: why.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
    kept = functions.join(why.filter("reason = 'kept'").select("fn_id"), "fn_id", "left_semi")
    nodes = s.table("nodes", lambda: trees_.join(kept.select("fn_id"), "fn_id", "left_semi"))
    parts = s.table("splits", lambda: splits.split_rows(kept, data).select("fn_id", "target", "project", "part"), ("part",))
    edges = s.table("edges", lambda: trees.all_edges(nodes), ("etype",))
    labels = parts.select("fn_id", F.col("target").alias("label"), F.col("part").alias("split"), "project")
    leaves = nodes.filter("is_leaf AND code IS NOT NULL").select("fn_id", "node_id", "start_byte", "code").join(labels, "fn_id")
    types = s.table("type_vocabulary", lambda: trees.vocabulary(nodes, "type", ["fn_id", "node_id"], 1, "type_id").withColumnRenamed("term", "type"))
    tokens = s.table("token_vocabulary", lambda: trees.vocabulary(leaves.filter("split = 'train'"), "code", ["fn_id", "start_byte", "node_id"], 2, "token_id").withColumnRenamed("term", "token"))
    s.table("sequences", lambda: graphs.sequences(leaves, tokens, "label", "project", "split"), ("split",))
    dim = embedding["word2vec_dim"]
    vectors = s.table("word_vectors", lambda: features.word_vectors(trees.leaf_tokens(nodes), dim, embedding["word2vec_window"], embedding["word2vec_min_count"], embedding["word2vec_epochs"]))
    s.table("embedding_matrix", lambda: models.matrix(tokens, vectors, dim))
    type_ids = nodes.join(types, "type", "left").select("fn_id", "node_id", F.coalesce("type_id", F.lit(0)).alias("type_id"))
    mode = embedding["internal_code"]
    s.table("featurizer", lambda: spark.createDataFrame([(mode, dim)], "internal_code string, dim int").coalesce(1))
    s.table("samples", lambda: models.samples(nodes, trees.distinct_edges(edges), vectors, type_ids, labels, dim, mode), ("split",))
    s.table("metrics", lambda: trees.function_metrics(nodes, edges))
    return s.made


def load_featurizer(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, str]:
    """(token vectors, type vocabulary, mode of inner nodes) of a prepared corpus; the mode is 'mean' where none was written."""
    vectors, types = (spark.read.parquet(f"{out}/{name}") for name in ("word_vectors", "type_vocabulary"))
    mode = spark.read.parquet(f"{out}/featurizer").first()["internal_code"] if complete(spark, f"{out}/featurizer") else "mean"
    return vectors, types, mode


def main(args: list[str]) -> int:
    force = "--force" in args
    config = load_config(args[args.index("--config") + 1]) if "--config" in args else None
    paths = [a for a in args if not a.startswith("--") and (config is None or a != args[args.index("--config") + 1])]
    if len(paths) != 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("prepare").getOrCreate()
    print("made:", *prepare(spark, *paths, config=config, force=force))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
