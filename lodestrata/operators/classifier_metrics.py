"""Metrics of scored records: confusion counts, accuracy, precision, recall, F1, MCC, AUC, and decision thresholds.

Input is (project, label, prob); rows whose label or prob is null take no part. Every ratio is guarded: a zero
denominator gives 0. All grouped forms work on the histogram of (group, prob) counts; running sums over it are cut into
ranges of the probability, so that the order of a hot group's rows never goes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ranking import number_cell, spread_next, spread_rank, spread_sums
from lodestrata.session import materialize

COMBINED = "Combined"
#: Beyond this many distinct probabilities the candidates come from an even grid of their quantiles.
MAX_CANDIDATES = 512


def ratio(a: Column, b: Column, times: float = 100.0) -> Column:
    return F.when(b != 0, a * F.lit(times) / b).otherwise(F.lit(0.0))


def usable(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("label").isNotNull() & F.col("prob").isNotNull() & ~F.isnan("prob"))


def rates(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1 in percent, MCC in percent."""
    t, n, p, m = (c.cast("double") for c in (tp, tn, fp, fn))
    precision, recall = ratio(t, t + p), ratio(t, t + m)
    root = F.sqrt((t + p) * (t + m) * (n + p) * (n + m))
    return {
        "accuracy": ratio(t + n, t + n + p + m),
        "precision": precision,
        "recall": recall,
        "f1": F.when(precision + recall != 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0)),
        "mcc": ratio(t * n - p * m, root),
    }


def confusion(scored: DataFrame, keys: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """tp, tn, fp, fn for each group of ``keys``; a probability equal to the threshold counts as positive."""
    hit = F.col("prob") >= threshold
    yes = F.col("label") == 1
    return usable(scored).groupBy(*keys).agg(F.count_if(hit & yes).alias("tp"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"))


def project_metrics(scored: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """All counts and rates, to six digits, for each project and for all rows together, from one pass (grouping sets)."""
    rows = usable(scored).withColumn("hit", F.col("prob") >= threshold).withColumn("yes", F.col("label") == 1)
    hit, yes = F.col("hit"), F.col("yes")
    counts = rows.rollup("project").agg(
        F.grouping("project").alias("all_rows"),
        F.count_if(hit & yes).alias("tp"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"),
    )
    counts = counts.withColumn("project", F.when(F.col("all_rows") == 1, F.lit(COMBINED)).otherwise(F.col("project"))).drop("all_rows")
    return counts.select("*", *[F.round(c, 6).alias(k) for k, c in rates(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")).items()])


def histogram(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prob, p, n): positives and negatives at each probability."""
    return usable(scored).groupBy(*keys, "prob").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve in percent with ties as one half; 50 where only one class is present."""
    h = spread_sums(histogram(scored, keys), keys, ["prob"], number_cell(F.col("prob"), 0, 1), ["n"])
    s = h.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2.0)).alias("wins"), F.sum("p").cast("double").alias("pos"), F.sum("n").cast("double").alias("neg"))
    return s.select(*keys, F.when(F.col("pos") * F.col("neg") > 0, F.col("wins") * 100.0 / (F.col("pos") * F.col("neg"))).otherwise(F.lit(50.0)).alias("auc"))


def _with(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``other``, joined on ``keys``, of which null ones are equal too."""
    other = other.select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    return df.join(other, cond).drop(*[f"__o{i}" for i in range(len(keys))])


def candidate_sweep(scored: DataFrame, keys: list[str]) -> DataFrame:
    """tp, tn, fp, fn at every candidate threshold of each group.

    Candidates: 0.5 and the midpoints of neighbouring distinct probabilities; of more than ``MAX_CANDIDATES`` distinct
    ones, the midpoints of as many even quantiles, which lie between neighbours of known ranks. Candidates are merged into
    the probabilities' order by running sums instead of being joined with every row.
    """
    h = materialize(histogram(scored, keys), "histogram")  # all that follows reads this instead of the rows
    cell = number_cell(F.col("prob"), 0, 1)
    totals = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    ranked = spread_next(spread_rank(h.select(*keys, "prob"), keys, ["prob"], cell, "r"), keys, "prob", cell)
    ranked = _with(ranked, totals.select(*keys, "distinct"), keys).withColumn("r", F.col("r") - 1)
    plain = ranked.filter((F.col("distinct") <= MAX_CANDIDATES) & F.col("next").isNotNull()).select(*keys, ((F.col("prob") + F.col("next")) / 2).alias("thr"))
    # quantile k of the grid lies at k * (distinct - 1) / steps: between this rank and the next for the k from lo to hi
    steps, gaps = MAX_CANDIDATES - 1, F.col("distinct") - 1
    many = ranked.filter(F.col("distinct") > MAX_CANDIDATES)
    many = many.withColumn("lo", F.expr(f"(r * {steps} + distinct - 2) div (distinct - 1)")).withColumn("hi", F.least(F.lit(steps), F.expr(f"((r + 1) * {steps} - 1) div (distinct - 1)")))
    grid = many.filter("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi")))
    part = (F.col("k") * gaps - F.col("r") * steps) / F.lit(float(steps))
    grid = grid.select(*keys, "k", F.when(part > 0, F.col("prob") + (F.col("next") - F.col("prob")) * part).otherwise(F.col("prob")).alias("q"))
    grid = grid.withColumn("q2", F.lead("q").over(Window.partitionBy(*keys).orderBy("k")))  # MAX_CANDIDATES rows a key
    coarse = grid.filter("q2 IS NOT NULL").select(*keys, ((F.col("q") + F.col("q2")) / 2).alias("thr"))
    half = totals.select(*keys, F.lit(0.5).alias("thr"))
    thr = materialize(plain.unionByName(coarse).unionByName(half).distinct(), "candidates")
    zero = F.lit(0).cast("bigint")
    events = h.select(*keys, F.col("prob").alias("x"), F.lit(1).alias("kind"), "p", "n").unionByName(thr.select(*keys, F.col("thr").alias("x"), F.lit(0).alias("kind"), zero.alias("p"), zero.alias("n")))
    e = spread_sums(events, keys, ["x", "kind"], number_cell(F.col("x"), 0, 1), ["p", "n"]).filter("kind = 0")
    e = _with(e, totals.drop("distinct"), keys)
    return e.select(*keys, F.col("x").alias("threshold"), (F.col("pos") - F.col("before_p")).alias("tp"), F.col("before_n").alias("tn"), (F.col("neg") - F.col("before_n")).alias("fp"), F.col("before_p").alias("fn"))


def best_threshold(scored: DataFrame, keys: list[str], objective: str = "f1_guarded") -> DataFrame:
    """(keys, threshold, score): the candidate of the best score; ties go to the lowest one; 0.5 where one class is missing.

    ``f1_guarded`` takes the best F1 among the candidates whose accuracy is not below that at 0.5; ``mcc``, ``f1`` and
    ``accuracy`` are maximised as they are.
    """
    if objective not in ("f1_guarded", "mcc", "f1", "accuracy"):
        raise ValueError(f"unknown objective {objective}")
    sweep = candidate_sweep(scored, keys)
    r = rates(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))
    sweep = sweep.select("*", r["accuracy"].alias("accuracy"), r["f1"].alias("f1"), r["mcc"].alias("mcc"))
    w = Window.partitionBy(*keys)
    if objective == "f1_guarded":
        floor = F.max(F.when(F.col("threshold") == 0.5, F.col("accuracy"))).over(w)
        sweep = sweep.withColumn("floor", floor).filter(F.col("accuracy") + 1e-9 >= F.col("floor"))
    score = "f1" if objective == "f1_guarded" else objective
    best = sweep.groupBy(*keys).agg(F.max_by(F.struct("threshold", score), F.struct(F.round(score, 9), -F.col("threshold"))).alias("b"), F.max(F.col("tp") + F.col("fn")).alias("pos"), F.max(F.col("tn") + F.col("fp")).alias("neg"))
    one = (F.col("pos") == 0) | (F.col("neg") == 0)
    return best.select(*keys, F.when(one, F.lit(0.5)).otherwise(F.col("b.threshold")).alias("threshold"), F.when(one, F.lit(0.0)).otherwise(F.col(f"b.{score}")).alias("score"))


def apply_threshold(scored: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``predicted`` by their group's threshold; 0.5 where the group has none."""
    joined = scored.join(thresholds.select(*keys, "threshold"), keys, "left") if keys else scored.join(F.broadcast(thresholds.select("threshold").limit(1)))
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(0.5))).withColumn("predicted", (F.col("prob") >= F.col("threshold")).cast("int"))
