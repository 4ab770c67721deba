"""The queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import encode, eval_leaks, format_duplicates, group_splits, packing, proportional_sample, shared_spans, split_overlap, term_counts
from lodestrata.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.duplicate_rows(*_p1_groups(spark, sf_dir))


def _p1_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    functions = format_duplicates.function_records(table(spark, sf_dir, "raw_functions"))
    return format_duplicates.format_groups(functions.unionByName(format_duplicates.payload_records(table(spark, sf_dir, "raw_records"))))


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each set of same records, with the number of its copies."""
    groups, _ = _p1_groups(spark, sf_dir)
    return groups.select("origin", "keep_id", "copies")


def _p2_placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    budgets = table(spark, sf_dir, "node_budgets")
    return packing.pack(packing.items_of(table(spark, sf_dir, "graph_samples"), "fn_id", "num_nodes", "label"), budgets), budgets


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_items(_p2_placed(spark, sf_dir)[0]).withColumnRenamed("id", "fn_id")


def p2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every graph, for each budget."""
    return _p2_placed(spark, sf_dir)[0].withColumnRenamed("id", "fn_id")


def p2_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, items and unused room of each budget."""
    return packing.fill_report(*_p2_placed(spark, sf_dir))


#: Limits of ``p2_limits``: graphs in a container, and the part of its nodes that may lie in labelled graphs.
P2_SEGMENTS, P2_LOSS_PERMILLE = 8, 600


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing under all three limits at once: the fullest containers of each budget by segments and by loss-bearing nodes."""
    items = packing.items_of(table(spark, sf_dir, "graph_samples"), "fn_id", "num_nodes", "label")
    return packing.limit_report(packing.pack(items, table(spark, sf_dir, "node_budgets"), P2_SEGMENTS, loss_permille=P2_LOSS_PERMILLE), items)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report, _ = proportional_sample.plan_sample(table(spark, sf_dir, "raw_functions"), table(spark, sf_dir, "sample_targets"))
    return report.filter("NOT met").select("project", "target")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn rows."""
    usable, report, _ = proportional_sample.plan_sample(table(spark, sf_dir, "raw_functions"), table(spark, sf_dir, "sample_targets"))
    return proportional_sample.draw(usable, report).select("fn_id", "project", "target", "rank")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, usable and drawn rows of each category."""
    return proportional_sample.plan_sample(table(spark, sf_dir, "raw_functions"), table(spark, sf_dir, "sample_targets"))[1]


def _p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, nodes = table(spark, sf_dir, "raw_functions"), table(spark, sf_dir, "ast_nodes")
    words = term_counts.count_words(functions, "func").withColumn("field", F.lit("func"))
    types = term_counts.count_values(nodes, "fn_id", "node_id", "type").withColumn("field", F.lit("type"))
    sizes = functions.agg(F.count("func").alias("total")).withColumn("field", F.lit("func"))
    sizes = sizes.unionByName(nodes.agg(F.count_distinct("fn_id").alias("total")).withColumn("field", F.lit("type")))
    counted = words.unionByName(types).join(F.broadcast(sizes), "field")  # two rows
    return counted.select("field", "term", "occurrences", F.col("records").alias("functions"), term_counts.mark(F.col("records"), F.col("total")).alias("mark"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4_terms(spark, sf_dir).filter("mark IS NOT NULL").select("field", "term", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and functions of every word and node type."""
    return _p4_terms(spark, sf_dir)


def p4_type_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and functions of every run of up to three node types in pre-order."""
    return term_counts.count_values(table(spark, sf_dir, "ast_nodes"), "fn_id", "node_id", "type", max_n=3).withColumnRenamed("records", "functions")


def p4_func_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and functions of every run of up to three words of the functions' texts."""
    return term_counts.count_words(table(spark, sf_dir, "raw_functions"), "func", max_n=3).withColumnRenamed("records", "functions")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "raw_functions")
    return split_overlap.all_pairs(split_overlap.overlaps(functions), functions)


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts across splits, with their shared segments and word edits."""
    found = split_overlap.overlaps(table(spark, sf_dir, "raw_functions"), aligned=True)
    return found.select(F.col("id_a").alias("held_out_id"), F.col("id_b").alias("train_id"), "shared", "total", "edits")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out functions that overlap with training, and their pairs, for each split and project."""
    functions = table(spark, sf_dir, "raw_functions")
    pairs = p5_found(spark, sf_dir)
    held = functions.filter(F.col("split").isin(*split_overlap.HELD_OUT)).select(F.col("fn_id").alias("h"), "split", proportional_sample.clean_project(F.col("project")).alias("project"))
    both = pairs.select(F.explode(F.array("fn_id_a", "fn_id_b")).alias("h"))
    return both.join(held, "h").groupBy("split", "project").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("h").alias("functions"))


def _p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.entity_groups(group_splits.named_commits(table(spark, sf_dir, "raw_functions")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.tied_records(_p6_groups(spark, sf_dir)).withColumnRenamed("id", "fn_id")


def _p6_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.assign_splits(table(spark, sf_dir, "raw_functions"), _p6_groups(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p6_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row."""
    return _p6_assigned(spark, sf_dir).select(F.col("id").alias("fn_id"), "group_key", "split")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split, and how many of them have the label 1."""
    return _p6_assigned(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positive"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def _p8_leaks(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    return eval_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edited=edited)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.leaked(_p8_leaks(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document and item that share four words in sequence, edited copies included."""
    return _p8_leaks(spark, sf_dir, edited=True).drop("score")


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item wholly, edited or not, accepted by the alignment's score."""
    return eval_leaks.edited_copies(_p8_leaks(spark, sf_dir, edited=True))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shared_spans.sharing_pairs(shared_spans.shared_spans(docs), shared_spans.members_of(docs))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in others too."""
    docs = table(spark, sf_dir, "documents")
    return shared_spans.shared_part(shared_spans.shared_spans(docs), docs)


QUERIES = {
    "p1_found": p1_found,
    "p1_copies": p1_copies,
    "p2_found": p2_found,
    "p2_pack": p2_pack,
    "p2_fill": p2_fill,
    "p2_limits": p2_limits,
    "p3_found": p3_found,
    "p3_sample": p3_sample,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p4_type_grams": p4_type_grams,
    "p4_func_grams": p4_func_grams,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_split": p6_split,
    "p6_shares": p6_shares,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_edited": p8_edited,
    "p9_found": p9_found,
    "p9_shared": p9_shared,
}

_P1_RECORDS = r"""
WITH payloads AS (
    SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM raw_records
), fields AS (
    SELECT record_id,
           coalesce(nullif(p->>'func', ''), nullif(p->>'function', ''), nullif(p->>'code', '')) AS func,
           coalesce(nullif(p->>'target', ''), nullif(p->>'label', '')) AS target
    FROM payloads
), records AS (
    SELECT 'raw_functions' AS origin, fn_id AS id, func, CAST(target AS DOUBLE) AS target FROM raw_functions
    UNION ALL
    SELECT 'raw_records', record_id, func,
           CASE lower(trim(target)) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE CAST(target AS DOUBLE) END FROM fields
), keyed AS (
    SELECT origin, id, target, regexp_replace(lower(func), '[^\p{L}\p{Nd}]', '', 'g') AS letters FROM records
), kept AS (
    SELECT origin, id, min(id) OVER (PARTITION BY origin, target, letters) AS keep_id
    FROM keyed WHERE letters <> '' AND target IS NOT NULL
)
"""

#: White space of any kind, for RE2.
_SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_P3_ROWS = rf"""
WITH usable AS (
    SELECT fn_id, lower(regexp_replace(regexp_replace(project, '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS project, target
    FROM raw_functions WHERE target IS NOT NULL AND regexp_replace(func, '{_SPACE}', '', 'g') <> ''
), size AS (
    SELECT count(*) // 10 AS n FROM raw_functions
), wanted AS (
    SELECT t.project, t.target, t.share_permille, t.min_rows, count(u.fn_id) AS usable
    FROM sample_targets t LEFT JOIN usable u ON u.project = t.project AND u.target = t.target GROUP BY ALL
), need AS (
    SELECT w.*, greatest((share_permille * n + 999) // 1000, min_rows) AS needed, n FROM wanted w, size
), ranked AS (
    SELECT u.fn_id, u.project, u.target, t.share_permille, t.min_rows,
           row_number() OVER (PARTITION BY u.project, u.target ORDER BY md5('sample:' || u.fn_id), u.fn_id) AS rank
    FROM usable u JOIN sample_targets t ON u.project = t.project AND u.target = t.target
), picked AS (
    SELECT *, row_number() OVER (ORDER BY CASE WHEN rank <= min_rows THEN 0 ELSE 1 END,
                                 CASE WHEN rank <= min_rows THEN rank ELSE (rank - 0.5) / share_permille END, project, target) AS place
    FROM ranked
), sample AS (
    SELECT * FROM picked WHERE place <= (SELECT n FROM size)
)
"""

_P4_TERMS = r"""
WITH words AS (
    SELECT fn_id, unnest(regexp_extract_all(func, '[A-Za-z0-9_]+')) AS term FROM raw_functions
), types AS (
    SELECT DISTINCT fn_id, node_id, type AS term FROM ast_nodes WHERE type IS NOT NULL
), counted AS (
    SELECT 'func' AS field, term, count(*) AS occurrences, count(DISTINCT fn_id) AS functions, (SELECT count(func) FROM raw_functions) AS total FROM words GROUP BY term
    UNION ALL
    SELECT 'type', term, count(*), count(DISTINCT fn_id), (SELECT count(DISTINCT fn_id) FROM ast_nodes) FROM types GROUP BY term
), marked AS (
    SELECT field, term, occurrences, functions, CASE WHEN functions < 3 THEN 'rare' WHEN functions * 1000 > total * 400 THEN 'common' END AS mark FROM counted
)
"""

_P5_PAIRS = r"""
WITH words AS (
    SELECT fn_id, split, project, regexp_extract_all(lower(func), '[a-z0-9_]+') AS w FROM raw_functions WHERE split IN ('train', 'val', 'test') AND func IS NOT NULL
), segments AS (
    SELECT DISTINCT fn_id, split = 'train' AS train, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) > 2
), sizes AS (
    SELECT fn_id, count(*) AS n FROM segments GROUP BY fn_id
), shared AS (
    SELECT a.fn_id AS x, b.fn_id AS y, count(*) AS k FROM segments a JOIN segments b ON a.s = b.s AND NOT a.train AND b.train GROUP BY a.fn_id, b.fn_id
), pairs AS (
    SELECT x, y FROM shared JOIN sizes p ON p.fn_id = x JOIN sizes q ON q.fn_id = y WHERE k * 1000 >= 700 * (p.n + q.n - k)
)
"""

_P9_WINDOWS = r"""
WITH windows AS (
    SELECT doc_id, i, hash(substring(text, i, 300)) AS h
    FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)
)
"""

ORACLE_SQL = {
    "p9_found": _P9_WINDOWS
    + """, once AS (SELECT DISTINCT doc_id, h FROM windows)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM once a JOIN once b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_shared": _P9_WINDOWS
    + """, elsewhere AS (
    SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), places AS (
    SELECT doc_id, least(300, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS n FROM windows SEMI JOIN elsewhere USING (h)
), covered AS (
    SELECT doc_id, sum(n) AS n FROM places GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars FROM documents LEFT JOIN covered USING (doc_id)""",
    "p5_found": _P5_PAIRS + "SELECT least(x, y) AS fn_id_a, greatest(x, y) AS fn_id_b FROM pairs",
    "p5_report": _P5_PAIRS
    + rf"""SELECT w.split, lower(regexp_replace(regexp_replace(project, '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS project, count(*) AS pairs, count(DISTINCT x) AS functions
FROM pairs JOIN words w ON w.fn_id = x GROUP BY 1, 2""",
    "p4_found": _P4_TERMS + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_terms": _P4_TERMS + "SELECT field, term, occurrences, functions, mark FROM marked",
    "p4_type_grams": """
WITH nodes AS (
    SELECT fn_id, node_id, min(type) AS type FROM ast_nodes GROUP BY fn_id, node_id
), placed AS (
    SELECT fn_id, type, lead(type) OVER w AS second, lead(type, 2) OVER w AS third FROM nodes WHERE type IS NOT NULL
    WINDOW w AS (PARTITION BY fn_id ORDER BY node_id)
), grams AS (
    SELECT fn_id, type AS term, 1 AS n FROM placed
    UNION ALL SELECT fn_id, type || ' ' || second, 2 FROM placed WHERE second IS NOT NULL
    UNION ALL SELECT fn_id, type || ' ' || second || ' ' || third, 3 FROM placed WHERE third IS NOT NULL
)
SELECT term, n, count(*) AS occurrences, count(DISTINCT fn_id) AS functions FROM grams GROUP BY term, n""",
    "p2_found": "SELECT DISTINCT b.budget_name, g.fn_id FROM graph_samples g JOIN node_budgets b ON g.num_nodes > b.max_nodes",
    "p3_found": _P3_ROWS + "SELECT project, target FROM need WHERE usable < needed",
    "p3_sample": _P3_ROWS + "SELECT fn_id, project, target, rank FROM sample",
    "p3_report": _P3_ROWS
    + """SELECT d.project, d.target, d.share_permille, d.min_rows, d.usable, d.needed, count(s.fn_id) AS seats, d.usable >= d.needed AS met
FROM need d LEFT JOIN sample s ON s.project = d.project AND s.target = d.target GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY d.project, d.target, d.share_permille, d.min_rows, d.usable, d.needed"),
    "p8_found": r"""
WITH items AS (
    SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM eval_items
), sized AS (
    SELECT item_id, w, least(12, len(w)) AS n FROM items WHERE len(w) > 0
), passages AS (
    SELECT DISTINCT item_id, n, hash(array_to_string(w[i:i + n - 1], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), docs AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents WHERE text IS NOT NULL
), windows AS (
    SELECT doc_id, n, hash(array_to_string(w[i:i + n - 1], ' ')) AS h FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM passages))
)
SELECT DISTINCT doc_id, item_id FROM windows JOIN passages USING (n, h)""",
    "p6_found": r"""
WITH RECURSIVE named AS (
    SELECT DISTINCT fn_id, unnest(list_filter(regexp_extract_all(lower(commit_id), '[0-9a-f]+'), lambda x: len(x) BETWEEN 12 AND 40)) AS name FROM raw_functions
), known AS (
    SELECT DISTINCT name FROM named WHERE len(name) = 40
), resolved AS (
    SELECT s.name, min(k.name) AS entity FROM (SELECT DISTINCT name FROM named WHERE len(name) < 40) s JOIN known k ON starts_with(k.name, s.name)
    GROUP BY s.name HAVING count(*) = 1
), links AS (
    SELECT fn_id, name AS entity FROM named WHERE len(name) = 40
    UNION SELECT n.fn_id, r.entity FROM named n JOIN resolved r ON n.name = r.name
), firsts AS (
    SELECT fn_id, min(entity) AS first FROM links GROUP BY fn_id
), edges AS (
    SELECT f.first AS a, l.entity AS b FROM links l JOIN firsts f USING (fn_id) WHERE l.entity <> f.first
    UNION SELECT l.entity, f.first FROM links l JOIN firsts f USING (fn_id) WHERE l.entity <> f.first
), reach(node, other) AS (
    SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other
), roots AS (
    SELECT node, min(other) AS root FROM reach GROUP BY node
), keyed AS (
    SELECT f.fn_id, coalesce(r.root, f.first) AS group_key FROM firsts f LEFT JOIN roots r ON r.node = f.first
)
SELECT fn_id, group_key FROM keyed QUALIFY count(*) OVER (PARTITION BY group_key) > 1""",
    "p1_found": _P1_RECORDS + "SELECT DISTINCT origin, keep_id, id AS dup_id FROM kept WHERE id <> keep_id",
    "p1_copies": _P1_RECORDS + "SELECT origin, keep_id, count(*) AS copies FROM kept GROUP BY origin, keep_id",
}
