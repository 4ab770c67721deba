"""Queries over ``scored``: metrics, thresholds, imbalanced evaluation, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import classifier_metrics as m
from lodestrata.operators import splits
from lodestrata.session import table


def _scored(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    df = table(spark, sf_dir, "scored")
    return df.filter(F.col("split") == split) if split else df


def metrics_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and rates at 0.5 for each project and all rows."""
    return m.project_metrics(_scored(spark, sf_dir))


def confusion_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.confusion(_scored(spark, sf_dir), ["split"])


def auc_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-aware ROC AUC."""
    return m.auc(_scored(spark, sf_dir), ["split"])


def auc_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.auc(_scored(spark, sf_dir), ["project"])


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at every candidate threshold of the validation split."""
    return m.candidate_sweep(_scored(spark, sf_dir, "val"), ["split"]).drop("split")


def _best(objective: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return m.best_threshold(_scored(spark, sf_dir, "val"), ["project"], objective).select("project", F.round("threshold", 9).alias("threshold"), F.round("score", 6).alias("score"))

    run.__doc__ = f"Best threshold of each project by {objective} (E7, O3)."
    return run


def tuned_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds tuned on val, applied to test, measured for each project (E7 then A6)."""
    best = m.best_threshold(_scored(spark, sf_dir, "val"), ["project"])
    test = m.apply_threshold(m.usable(_scored(spark, sf_dir, "test")), best, ["project"])
    return m.project_metrics(test.withColumn("prob", F.col("predicted").cast("double")))


def imbalanced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in ten positive: threshold by MCC on the imbalanced val split, applied to the imbalanced test split."""
    rows = m.usable(_scored(spark, sf_dir))
    val = splits.imbalance(rows.filter("split = 'val'"), "label", "fn_id", 0.1)
    test = splits.imbalance(rows.filter("split = 'test'"), "label", "fn_id", 0.1)
    best = m.best_threshold(val.withColumn("g", F.lit(1)), ["g"], "mcc")
    scored = m.apply_threshold(test.withColumn("g", F.lit(1)), best, ["g"])
    return m.project_metrics(scored.withColumn("prob", F.col("predicted").cast("double")))


def result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'accuracy/f1' of each split for every project and all rows, one row each."""
    rows = _scored(spark, sf_dir)
    parts = [m.project_metrics(rows.filter(F.col("split") == s)).withColumn("method", F.lit(s)) for s in ("val", "test")]
    cell = F.format_string("%.2f/%.2f", F.bround("accuracy", 2), F.bround("f1", 2))  # ties to even, as printed floats are elsewhere
    return parts[0].unionByName(parts[1]).select("method", "project", cell.alias("cell"))


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'accuracy/f1' of every project and of all rows, one column for each split, '-' where a split has none of a project."""
    table_ = result_cells(spark, sf_dir).groupBy("project").pivot("method", ["val", "test"]).agg(F.first("cell"))
    return table_.select("project", *[F.coalesce(s, F.lit("-")).alias(s) for s in ("val", "test")])


def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed difference of test and val accuracy and F1 for each project."""
    rows = _scored(spark, sf_dir)
    val = m.project_metrics(rows.filter("split = 'val'")).select("project", F.col("accuracy").alias("va"), F.col("f1").alias("vf"))
    test = m.project_metrics(rows.filter("split = 'test'")).select("project", F.col("accuracy").alias("ta"), F.col("f1").alias("tf"))
    both = val.join(test, val["project"].eqNullSafe(test["project"]), "left").drop(test["project"])
    return both.select("project", F.when(F.col("ta").isNotNull(), F.format_string("%+.2f", F.round(F.col("ta") - F.col("va"), 2))).alias("accuracy_gap"), F.round(F.col("tf") - F.col("vf"), 2).alias("f1_gap"))


def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives over positives of each project, 1 without positives."""
    rows = table(spark, sf_dir, "scored").filter("label IS NOT NULL")
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)
    return rows.groupBy("project").agg(F.when(pos > 0, neg / pos).otherwise(F.lit(1.0)).alias("weight"))


QUERIES = {
    "metrics_by_project": metrics_by_project,
    "confusion_by_split": confusion_by_split,
    "auc_by_split": auc_by_split,
    "auc_by_project": auc_by_project,
    "threshold_sweep": threshold_sweep,
    "threshold_f1_guarded": _best("f1_guarded"),
    "threshold_mcc": _best("mcc"),
    "threshold_f1": _best("f1"),
    "threshold_accuracy": _best("accuracy"),
    "tuned_test_metrics": tuned_test_metrics,
    "imbalanced_metrics": imbalanced_metrics,
    "result_cells": result_cells,
    "result_table": result_table,
    "metric_deltas": metric_deltas,
    "class_weight": class_weight,
}

_USABLE = "SELECT * FROM scored WHERE label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob)"


def _counts(hit: str) -> str:
    return f"""count(*) FILTER (WHERE {hit} AND label = 1) AS tp, count(*) FILTER (WHERE NOT ({hit}) AND label <> 1) AS tn,
       count(*) FILTER (WHERE {hit} AND label <> 1) AS fp, count(*) FILTER (WHERE NOT ({hit}) AND label = 1) AS fn"""


def _rates(source: str, keys: str) -> str:
    """Counts and rates of rows (keys, tp, tn, fp, fn)."""
    return f"""
SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
    SELECT {keys}, tp, tn, fp, fn,
           CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) * 100.0 / (tp + tn + fp + fn) ELSE 0 END AS accuracy,
           CASE WHEN tp + fp > 0 THEN tp * CAST(100 AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
           CASE WHEN tp + fn > 0 THEN tp * CAST(100 AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
           CASE WHEN (tp + fp) > 0 AND (tp + fn) > 0 AND (tn + fp) > 0 AND (tn + fn) > 0
                THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) * 100 / (sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE))) ELSE 0 END AS mcc
    FROM ({source}))"""


def _by_project(rows: str, hit: str) -> str:
    source = f"SELECT CASE WHEN grouping(project) = 1 THEN 'Combined' ELSE project END AS project, {_counts(hit)} FROM ({rows}) GROUP BY GROUPING SETS ((project), ())"
    return "SELECT project, tp, tn, fp, fn, " + ", ".join(f"round({k}, 6) AS {k}" for k in ("accuracy", "precision", "recall", "mcc", "f1")) + f" FROM ({_rates(source, 'project')})"


def _auc(key: str) -> str:
    return f"""
WITH u AS ({_USABLE}), r AS (
    SELECT {key}, label, rank() OVER (PARTITION BY {key} ORDER BY prob) + (count(*) OVER (PARTITION BY {key}, prob) - 1) / 2.0 AS midrank FROM u
), s AS (
    SELECT {key}, sum(CASE WHEN label = 1 THEN midrank END) AS ranks, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n FROM r GROUP BY {key}
)
SELECT {key}, CASE WHEN p * n > 0 THEN 100.0 * (ranks - p * (p + 1) / 2.0) / (p * n) ELSE 50.0 END AS auc FROM s"""


def _sweep(key: str, rows: str) -> str:
    """CTEs u, thr and swept: counts at every candidate."""
    return f"""
u AS ({rows}), d AS (
    SELECT DISTINCT {key}, prob FROM u
), many AS (
    SELECT {key}, count(*) AS n FROM d GROUP BY {key}
), grid AS (
    SELECT {key}, unnest(quantile_cont(prob, [{", ".join(f"CAST({k} AS DOUBLE) / 511" for k in range(512))}])) AS prob FROM d JOIN many USING ({key}) WHERE n > 512 GROUP BY {key}
), points AS (
    SELECT d.{key}, prob FROM d JOIN many USING ({key}) WHERE n <= 512 UNION ALL SELECT {key}, prob FROM grid
), mids AS (
    SELECT {key}, (prob + lead(prob) OVER (PARTITION BY {key} ORDER BY prob)) / 2 AS thr FROM points
), thr AS (
    SELECT {key}, thr FROM mids WHERE thr IS NOT NULL UNION SELECT {key}, 0.5 FROM many
), swept AS (
    SELECT thr.{key}, thr.thr, {_counts("prob >= thr.thr")} FROM thr JOIN u ON u.{key} = thr.{key} GROUP BY thr.{key}, thr.thr
)"""


def _best_sql(objective: str, key: str = "project", rows: str = _USABLE + " AND split = 'val'") -> str:
    score = "f1" if objective == "f1_guarded" else objective
    guard = "WHERE accuracy + 1e-9 >= floor" if objective == "f1_guarded" else ""
    return f"""
WITH {_sweep(key, rows)}, rated AS ({_rates("SELECT * FROM swept", f"{key}, thr")}
), floored AS (
    SELECT *, max(CASE WHEN thr = 0.5 THEN accuracy END) OVER (PARTITION BY {key}) AS floor FROM rated
), picked AS (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round({score}, 9) DESC, thr) AS k FROM floored {guard}
), best AS (
    SELECT {key}, CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 0.5 ELSE thr END AS threshold, CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 0 ELSE {score} END AS score FROM picked WHERE k = 1
)"""


def _imbalanced(split: str) -> str:
    """Rows of a split with all negatives and as many positives as make one in ten."""
    return f"""SELECT project, label, prob FROM (
    SELECT *, row_number() OVER (PARTITION BY label = 1 ORDER BY md5('imbalance:' || fn_id), fn_id) AS k, count(*) FILTER (WHERE label <> 1) OVER () AS safe
    FROM ({_USABLE} AND split = '{split}')) WHERE label <> 1 OR k <= CAST(round_even(safe * 0.1 / 0.9, 0) AS BIGINT)"""


ORACLE_SQL = {
    "metrics_by_project": _by_project(_USABLE, "prob >= 0.5"),
    "confusion_by_split": f"SELECT split, {_counts('prob >= 0.5')} FROM ({_USABLE}) GROUP BY split",
    "auc_by_split": _auc("split"),
    "auc_by_project": _auc("project"),
    "threshold_sweep": f"WITH {_sweep('split', _USABLE + chr(32) + 'AND split = ' + repr('val'))} SELECT thr AS threshold, tp, tn, fp, fn FROM swept",
    **{f"threshold_{o}": _best_sql(o) + " SELECT project, round(threshold, 9) AS threshold, round(score, 6) AS score FROM best" for o in ("f1_guarded", "mcc", "f1", "accuracy")},
    "tuned_test_metrics": _best_sql("f1_guarded") + _by_project(f"SELECT t.*, b.threshold FROM ({_USABLE} AND split = 'test') t LEFT JOIN best b USING (project)", "prob >= coalesce(threshold, 0.5)"),
    "imbalanced_metrics": _best_sql("mcc", "g", f"SELECT 1 AS g, * FROM ({_imbalanced('val')})") + _by_project(f"SELECT t.*, b.threshold FROM ({_imbalanced('test')}) t, best b", "prob >= threshold"),
    "metric_deltas": f"""
WITH v AS ({_by_project(_USABLE + " AND split = 'val'", "prob >= 0.5")}), t AS ({_by_project(_USABLE + " AND split = 'test'", "prob >= 0.5")})
SELECT v.project, printf('%+.2f', round(t.accuracy - v.accuracy, 2)) AS accuracy_gap, round(t.f1 - v.f1, 2) AS f1_gap FROM v LEFT JOIN t ON v.project IS NOT DISTINCT FROM t.project""",
    "class_weight": "SELECT project, CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN count(*) FILTER (WHERE label <> 1) / count(*) FILTER (WHERE label = 1) ELSE 1 END AS weight FROM scored WHERE label IS NOT NULL GROUP BY project",
    "result_cells": " UNION ALL ".join(f"SELECT '{s}' AS method, project, printf('%.2f/%.2f', accuracy, f1) AS cell FROM ({_by_project(_USABLE + f" AND split = '{s}'", 'prob >= 0.5')})" for s in ("val", "test")),
    "result_table": f"""
WITH r AS (SELECT 'val' AS method, * FROM ({_by_project(_USABLE + " AND split = 'val'", "prob >= 0.5")}) UNION ALL SELECT 'test', * FROM ({_by_project(_USABLE + " AND split = 'test'", "prob >= 0.5")}))
SELECT project, {", ".join(f"coalesce(max(CASE WHEN method = '{s}' THEN printf('%.2f/%.2f', accuracy, f1) END), '-') AS {s}" for s in ("val", "test"))} FROM r GROUP BY project""",
}
