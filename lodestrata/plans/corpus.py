"""Queries over ``raw_functions`` and ``raw_records``: loading, exact copies, composition, splits, holdouts, analysers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import patterns
from lodestrata.functions.texts import has_text, name_of
from lodestrata.operators import classifier_metrics, splits
from lodestrata.plans.graphs import _SPACE
from lodestrata.session import table
from lodestrata.sources import records

PER_PROJECT = 56


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with a text that isn't blank, projects trimmed and in lower case, commits '' where missing."""
    return cleaned(table(spark, sf_dir, "raw_functions"))


def cleaned(raw: DataFrame) -> DataFrame:
    """Rows with a text that isn't white space alone; one spelling for each project and commit, whatever white space stands around it."""
    return raw.filter(has_text("func")).withColumns({k: name_of(k) for k in ("project", "commit_id")})


def first_copies(df: DataFrame, text_col: str = "func", id_col: str = "fn_id") -> DataFrame:
    """The row of the smallest id of each text (A1). The shuffle carries a digest and the id; texts stay where they are read."""
    keyed = df.withColumn("__k", F.sha2(text_col, 256))
    first = keyed.groupBy("__k").agg(F.min(id_col).alias("__first"))
    return keyed.join(first, (keyed["__k"] == first["__k"]) & (F.col(id_col) == F.col("__first")), "left_semi").drop("__k")


def exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions left after exact copies are dropped."""
    return first_copies(_clean(spark, sf_dir)).select("fn_id", "project", "target")


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, positives, negatives and distinct commits of each project; the total row has no commits (A2)."""
    rows = first_copies(_clean(spark, sf_dir))
    g = rows.groupingSets([[F.col("project")], []], "project").agg(
        F.grouping("project").alias("g"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("target") == 1).alias("vulnerable"), F.count_if(F.col("target") == 0).alias("safe"), F.count_distinct("commit_id").alias("c")
    )
    return g.select(F.when(F.col("g") == 1, "Total").otherwise(F.col("project")).alias("project"), "total", "vulnerable", "safe", F.when(F.col("g") == 0, F.col("c")).alias("commits"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, positives and their share."""
    n = F.count(F.lit(1))
    return _clean(spark, sf_dir).agg(n.alias("functions"), F.sum("target").alias("positive"), classifier_metrics.ratio(F.sum("target").cast("double"), n).alias("percent"))


def loaded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered JSON records by the loader's field names."""
    rows = records.parse_payloads(table(spark, sf_dir, "raw_records"), "payload", "record_id")
    return rows.select("record_id", F.md5("func").alias("func_md5"), "target", "project", "name", "cwe", "commit_id")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-stratified train, val and test."""
    return splits.stratified(_clean(spark, sf_dir), "target", "fn_id").select("fn_id", "target", "part")


def commit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split without a commit on both sides."""
    return splits.group_disjoint(_clean(spark, sf_dir), "commit_id", "fn_id").select("fn_id", "part")


def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of positives of each part of the stratified split."""
    n = F.count(F.lit(1))
    return stratified_split(spark, sf_dir).groupBy("part").agg(n.alias("rows"), (F.sum("target") * 100.0 / n).alias("percent"))


def imbalanced_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All negatives and as many positives as make one in ten."""
    return splits.imbalance(_clean(spark, sf_dir), "target", "fn_id", 0.1).select("fn_id", "target")


def unseen_commit_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives of test whose commit isn't in train, at most ``PER_PROJECT`` of each project."""
    return splits.unseen_group_holdout(_clean(spark, sf_dir), "split", "target", "commit_id", "project", "fn_id", PER_PROJECT).select("fn_id", "project")


def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and distinct commits of the holdout by project."""
    rows = splits.unseen_group_holdout(_clean(spark, sf_dir), "split", "target", "commit_id", "project", "fn_id", PER_PROJECT)
    scored = table(spark, sf_dir, "scored").filter("prob IS NOT NULL").select(F.col("fn_id").alias("s"), "prob")
    hit = F.avg(F.when(F.col("prob") >= 0.5, 100.0).when(F.col("prob") < 0.5, 0.0))
    return rows.join(scored, F.col("fn_id") == F.col("s"), "left").groupBy("project").agg(F.count(F.lit(1)).alias("functions"), F.count_distinct("commit_id").alias("commits"), hit.alias("accuracy"))


def commit_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out functions of the delivered split whose commit also stands in train (E9), by split."""
    rows = _clean(spark, sf_dir)
    seen = rows.filter("split = 'train' AND commit_id <> ''").select("commit_id").distinct().withColumn("seen", F.lit(True))
    held = rows.filter("split IN ('val', 'test')").join(seen, "commit_id", "left")
    return held.groupBy("split").agg(F.count(F.lit(1)).alias("functions"), F.count_if("seen").alias("leaked"))


def leakage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and F1 on held-out functions with a commit in train against those without, and the difference."""
    rows = _clean(spark, sf_dir)
    seen = rows.filter("split = 'train' AND commit_id <> ''").select("commit_id").distinct().withColumn("seen", F.lit(True))
    held = rows.filter("split IN ('val', 'test')").join(seen, "commit_id", "left").select("fn_id", F.coalesce("seen", F.lit(False)).alias("seen"))
    counts = classifier_metrics.confusion(table(spark, sf_dir, "scored").drop("split").join(held, "fn_id"), ["seen"])
    r = classifier_metrics.rates(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))
    rated = counts.select("seen", r["accuracy"].alias("accuracy"), r["f1"].alias("f1"))
    side = lambda flag, name: F.max(F.when(F.col("seen") == flag, F.col(name)))
    cells = [F.round(side(True, k) - side(False, k), 2).alias(f"{k}_gap") for k in ("accuracy", "f1")]
    return rated.agg(*[F.round(side(True, k), 2).alias(f"{k}_seen") for k in ("accuracy", "f1")], *cells)


def analyser_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two analyser baselines say of each function."""
    return _clean(spark, sf_dir).select("fn_id", patterns.risky_call(F.col("func")).alias("risky_call"), patterns.memory_flaw(F.col("func")).alias("memory_flaw"))


def analyser_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the analyser baselines for each project."""
    rows = _clean(spark, sf_dir).filter("target IS NOT NULL").withColumn("label", F.col("target"))
    parts = [classifier_metrics.project_metrics(rows.withColumn("prob", f(F.col("func")).cast("double"))).withColumn("analyser", F.lit(name)) for name, f in (("risky_call", patterns.risky_call), ("memory_flaw", patterns.memory_flaw))]
    return parts[0].unionByName(parts[1])


def project_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by number of functions, with their share of all."""
    counted = _clean(spark, sf_dir).groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("project", "n", F.rank().over(Window.orderBy(F.desc("n"))).cast("bigint").alias("place"))  # one row for each project


QUERIES = {f.__name__: f for f in (
    exact_first, composition, totals, loaded_records, stratified_split, commit_split, split_balance, imbalanced_subset, unseen_commit_holdout, holdout_summary,
    commit_leakage, leakage_gap, analyser_flags, analyser_metrics, project_ranks,
)}

#: White space of any kind, for RE2; and what Java's \s is.
_S = _SPACE
_ASCII_S = r"[ \t\n\x0b\f\r]"


def _trimmed(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^{_S}+', ''), '{_S}+$', '')"


_CLEAN = rf"""clean AS (
    SELECT * REPLACE (coalesce(lower({_trimmed("project")}), '') AS project, coalesce(lower({_trimmed("commit_id")}), '') AS commit_id)
    FROM raw_functions WHERE regexp_matches(func, '[^{_S[1:]}')
)"""
_FIRST = "firsts AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY func ORDER BY fn_id) = 1)"
_STRATA = """strata AS (
    SELECT fn_id, target, CASE WHEN r <= floor(n * 0.75) THEN 'train' WHEN r <= floor(n * 0.75) + floor(n * 0.125) THEN 'val' ELSE 'test' END AS part FROM (
        SELECT fn_id, target, row_number() OVER (PARTITION BY target ORDER BY md5('stratified:' || fn_id), fn_id) AS r, count(*) OVER (PARTITION BY target) AS n FROM clean WHERE target IS NOT NULL)
)"""
_HOLDOUT = """holdout AS (
    SELECT * FROM clean c WHERE split = 'test' AND target = 1 AND commit_id <> '' AND NOT EXISTS (SELECT 1 FROM clean t WHERE t.split = 'train' AND t.commit_id = c.commit_id)
    QUALIFY row_number() OVER (PARTITION BY project ORDER BY md5('holdout:' || fn_id), fn_id) <= 56
)"""
_RISKY = r"regexp_matches(func, '\bstrcpy\b|\bstrcat\b|\bsprintf\b|\bgets\b|\bscanf\b|\bsystem\b|\bexec[lv]p?\b|\bmemcpy\b|\bstrncpy\b|\bvsprintf\b|\bprintf\s*\(\s*[A-Za-z_]\w*\s*\)')::INTEGER"
_FLAW = r"""(regexp_matches(flat, '\[\s*\w+\s*<=\s*\w+\s*\]')
     OR (regexp_matches(flat, '\bmalloc\b') AND NOT regexp_matches(regexp_extract(flat, '(?s)^.*\bmalloc\b(.*)$', 1), '(?s)\bif\b.*NULL'))
     OR len(list_filter(range(1, len(parts)), lambda i: regexp_matches(parts[i + 1], '^\s*\(\s*\w+\s*\)')
            AND regexp_matches(regexp_replace(array_to_string(parts[i + 1:], 'free'), '^\s*\(\s*\w+\s*\)', ''), '\b' || regexp_extract(parts[i + 1], '^\s*\(\s*(\w+)\s*\)', 1) || '\b'))) > 0)::INTEGER"""
_FLAGS = rf"""flags AS (
    SELECT *, {_RISKY} AS risky_call, {_FLAW} AS memory_flaw FROM (
        SELECT *, regexp_split_to_array(flat, '\bfree\b') AS parts FROM (SELECT *, regexp_replace(func, '{_ASCII_S}+', ' ', 'g') AS flat FROM clean))
)"""


def _analyser(name: str) -> str:
    from lodestrata.plans.metrics import _by_project

    return f"SELECT '{name}' AS analyser, * FROM ({_by_project(f'SELECT project, target AS label, {name} AS prob FROM flags WHERE target IS NOT NULL', 'prob >= 0.5')})"


ORACLE_SQL = {
    "exact_first": f"WITH {_CLEAN}, {_FIRST} SELECT fn_id, project, target FROM firsts",
    "composition": f"""
WITH {_CLEAN}, {_FIRST} SELECT CASE WHEN grouping(project) = 1 THEN 'Total' ELSE project END AS project, count(*) AS total, count(*) FILTER (WHERE target = 1) AS vulnerable,
       count(*) FILTER (WHERE target = 0) AS safe, CASE WHEN grouping(project) = 0 THEN count(DISTINCT commit_id) END AS commits FROM firsts GROUP BY GROUPING SETS ((project), ())""",
    "totals": f"WITH {_CLEAN} SELECT count(*) AS functions, CAST(sum(target) AS BIGINT) AS positive, sum(target) * CAST(100 AS DOUBLE) / count(*) AS percent FROM clean",
    "loaded_records": r"""
WITH fields AS (
    SELECT record_id, coalesce(nullif(p->>'func', ''), nullif(p->>'function', ''), nullif(p->>'code', '')) AS func, lower(trim(coalesce(nullif(p->>'target', ''), nullif(p->>'label', '')))) AS t,
           coalesce(nullif(p->>'project', ''), nullif(p->>'repo', ''), 'unknown') AS project, coalesce(p->>'name', '') AS name, coalesce(p->>'cwe', '') AS cwe, coalesce(p->>'commit_id', '') AS commit_id
    FROM (SELECT record_id, payload AS p FROM raw_records WHERE json_valid(payload))
)
SELECT record_id, md5(func) AS func_md5, CAST(CASE t WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE TRY_CAST(t AS DOUBLE) END AS INTEGER) AS target, project, name, cwe, commit_id FROM fields WHERE func IS NOT NULL""",
    "stratified_split": f"WITH {_CLEAN}, {_STRATA} SELECT fn_id, target, part FROM strata",
    "split_balance": f"WITH {_CLEAN}, {_STRATA} SELECT part, count(*) AS rows, sum(target) * CAST(100 AS DOUBLE) / count(*) AS percent FROM strata GROUP BY part",
    "commit_split": f"""
WITH {_CLEAN}, keyed AS (
    SELECT fn_id, CASE WHEN commit_id = '' THEN 'row:' || fn_id ELSE 'grp:' || commit_id END AS g FROM clean
), groups AS (
    SELECT g, count(*) AS n FROM keyed GROUP BY g
), cum AS (
    SELECT g, n, coalesce(sum(n) OVER (ORDER BY md5('group:' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM groups
), placed AS (
    SELECT g, CASE WHEN before < floor(total * 0.75) THEN 'train' WHEN before - (SELECT sum(n) FROM cum WHERE before < floor(total * 0.75)) < floor(total * 0.125) THEN 'val' ELSE 'test' END AS part FROM cum
)
SELECT fn_id, part FROM keyed JOIN placed USING (g)""",
    "imbalanced_subset": f"""
WITH {_CLEAN} SELECT fn_id, target FROM (
    SELECT fn_id, target, row_number() OVER (PARTITION BY target ORDER BY md5('imbalance:' || fn_id), fn_id) AS r, count(*) FILTER (WHERE target <> 1) OVER () AS safe FROM clean WHERE target IS NOT NULL)
WHERE target <> 1 OR r <= CAST(round_even(safe * 0.1 / 0.9, 0) AS BIGINT)""",
    "unseen_commit_holdout": f"WITH {_CLEAN}, {_HOLDOUT} SELECT fn_id, project FROM holdout",
    "holdout_summary": f"""
WITH {_CLEAN}, {_HOLDOUT} SELECT project, count(*) AS functions, count(DISTINCT commit_id) AS commits, avg(CASE WHEN prob >= 0.5 THEN 100.0 WHEN prob < 0.5 THEN 0.0 END) AS accuracy
FROM holdout h LEFT JOIN (SELECT fn_id, prob FROM scored WHERE prob IS NOT NULL) s ON s.fn_id = h.fn_id GROUP BY project""",
    "commit_leakage": f"""
WITH {_CLEAN}, seen AS (SELECT DISTINCT commit_id FROM clean WHERE split = 'train' AND commit_id <> '')
SELECT split, count(*) AS functions, count(s.commit_id) AS leaked FROM clean c LEFT JOIN seen s ON s.commit_id = c.commit_id WHERE split IN ('val', 'test') GROUP BY split""",
    "leakage_gap": f"""
WITH {_CLEAN}, seen AS (SELECT DISTINCT commit_id FROM clean WHERE split = 'train' AND commit_id <> ''), held AS (
    SELECT c.fn_id, s.commit_id IS NOT NULL AS seen FROM clean c LEFT JOIN seen s ON s.commit_id = c.commit_id WHERE split IN ('val', 'test')
), counts AS (
    SELECT seen, count(*) FILTER (WHERE prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE prob >= 0.5 AND label <> 1) AS fp, count(*) FILTER (WHERE prob < 0.5 AND label = 1) AS fn, count(*) AS n,
           count(*) FILTER (WHERE (prob >= 0.5) = (label = 1)) AS good
    FROM scored s JOIN held h ON h.fn_id = s.fn_id WHERE label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) GROUP BY seen
), rated AS (
    SELECT seen, good * 100.0::DOUBLE / n AS accuracy, CASE WHEN 2 * tp + fp + fn > 0 THEN 200.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM counts
), sides AS (
    SELECT max(CASE WHEN seen THEN accuracy END) AS a, max(CASE WHEN NOT seen THEN accuracy END) AS b, max(CASE WHEN seen THEN f1 END) AS c, max(CASE WHEN NOT seen THEN f1 END) AS d FROM rated
)
SELECT round(a, 2) AS accuracy_seen, round(c, 2) AS f1_seen, round(a - b, 2) AS accuracy_gap, round(c - d, 2) AS f1_gap FROM sides""",
    "analyser_flags": f"WITH {_CLEAN}, {_FLAGS} SELECT fn_id, risky_call, memory_flaw FROM flags",
    "analyser_metrics": f"WITH {_CLEAN}, {_FLAGS} {_analyser('risky_call')} UNION ALL {_analyser('memory_flaw')}",
    "project_ranks": f"WITH {_CLEAN} SELECT project, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM clean GROUP BY project",
}
