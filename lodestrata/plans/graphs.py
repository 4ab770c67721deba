"""Queries over ``ast_nodes`` and the tables about parsed functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.texts import name_of
from lodestrata.operators import splits, trees
from lodestrata.session import materialize, table

#: Longest sequence of ``token_sequences_cut``, as its consumers pad to it.
MAX_TOKENS = 500
MIN_COUNT = 3
#: All edge types but control flow, which SQL can't say.
RELATIONAL_TYPES = [t for t in trees.EDGE_TYPES if t != "CFG"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.clean(table(spark, sf_dir, "ast_nodes"))


def _kept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table, for plans that read it many times."""
    return materialize(_nodes(spark, sf_dir), "nodes")


def ast_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent-child edges, both ways."""
    return trees.ast_edges(_nodes(spark, sf_dir))


def ncs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-token edges."""
    return trees.next_token_edges(_nodes(spark, sf_dir))


def identifier_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each identifier is read or written."""
    return trees.identifiers(_kept_nodes(spark, sf_dir)).select("fn_id", "node_id", "role")


def dfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow edges."""
    return trees.data_flow_edges(_kept_nodes(spark, sf_dir))


def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-flow edges."""
    return trees.control_flow_edges(_nodes(spark, sf_dir))


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each function and type, zero where there are none."""
    nodes = _kept_nodes(spark, sf_dir)
    return trees.edge_counts(trees.all_edges(nodes), nodes)


def edge_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct syntax, token and data-flow edges with self-loops of these types, and their norms."""
    nodes = materialize(trees.sized(_nodes(spark, sf_dir)), "nodes")
    return trees.edge_weights(relational_edges(nodes), nodes, kinds=RELATIONAL_TYPES)


def relational_edges(nodes: DataFrame) -> DataFrame:
    """Edges of ``RELATIONAL_TYPES``, repeated ones kept."""
    return trees.ast_edges(nodes).unionByName(trees.next_token_edges(nodes)).unionByName(trees.data_flow_edges(nodes))


def edge_norms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges of all seven types with self-loops, and their norms; has no SQL, as control flow has none."""
    nodes = materialize(trees.sized(_nodes(spark, sf_dir)), "nodes")
    return trees.edge_weights(trees.all_edges(nodes), nodes)


def ablated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a chosen set of types, renumbered in that order."""
    chosen = ["AST", "NCS", "DFG_W"]
    nodes = _kept_nodes(spark, sf_dir)
    edges = relational_edges(nodes).filter(F.col("etype").isin(chosen))
    ids = F.array_position(F.array(*[F.lit(t) for t in chosen]), F.col("etype")) - 1
    return trees.distinct_edges(edges).select("fn_id", ids.cast("int").alias("etype_id"), "src", "dst")


def edge_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all seven types that name a node their function doesn't have, counted by type; none are expected."""
    nodes = _kept_nodes(spark, sf_dir)
    return trees.edges_outside(trees.all_edges(nodes), nodes)


def max_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deepest nesting of loops and branches."""
    return trees.nesting(_nodes(spark, sf_dir))


def function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 metrics of each function (A10)."""
    nodes = _kept_nodes(spark, sf_dir)
    return trees.function_metrics(nodes, trees.all_edges(nodes))


def type_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node types numbered from 1 by first appearance; 0 is for unknown ones."""
    return trees.vocabulary(_nodes(spark, sf_dir), "type", ["fn_id", "node_id"], 1, "type_id").withColumnRenamed("term", "type")


def node_type_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type number of every node, 0 where it has none."""
    return _nodes(spark, sf_dir).join(type_vocabulary(spark, sf_dir), "type", "left").select("fn_id", "node_id", F.coalesce("type_id", F.lit(0)).alias("type_id"))


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _nodes(spark, sf_dir).filter("is_leaf AND code IS NOT NULL").select("fn_id", "node_id", "start_byte", "code")
    return leaves.join(table(spark, sf_dir, "raw_functions").select("fn_id", "split", "target"), "fn_id")


def token_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf tokens of training functions numbered from 2 by first appearance; 0 pads, 1 is unknown."""
    train = _leaves(spark, sf_dir).filter("split = 'train'")
    return trees.vocabulary(train, "code", ["fn_id", "start_byte", "node_id"], 2, "token_id").withColumnRenamed("term", "token")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf tokens that occur at least ``MIN_COUNT`` times."""
    return _leaves(spark, sf_dir).groupBy(F.col("code").alias("token")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def sequences(leaves: DataFrame, vocabulary: DataFrame, *keep: str) -> DataFrame:
    """(fn_id, *keep, token_ids): token numbers of each function's leaves in source order, 1 for tokens that the vocabulary (token, token_id) lacks."""
    rows = leaves.join(vocabulary.withColumnRenamed("token", "code"), "code", "left").withColumn("t", F.coalesce("token_id", F.lit(1)))
    ids = F.expr("transform(array_sort(collect_list(struct(start_byte, node_id, t))), x -> x.t)")
    return rows.groupBy("fn_id", *keep).agg(ids.alias("token_ids"))


def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token numbers of each function in source order, with label and split."""
    return sequences(_leaves(spark, sf_dir), token_vocabulary(spark, sf_dir), "target", "split")


def token_sequences_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as models take them: cut to ``MAX_TOKENS`` and padded with 0 to the longest that is left in each split."""
    rows = token_sequences(spark, sf_dir)
    longest = F.least(F.lit(MAX_TOKENS), F.max(F.size("token_ids")).over(Window.partitionBy("split")))  # one number a split
    return rows.select("fn_id", "target", "split", F.slice("token_ids", F.lit(1), F.lit(MAX_TOKENS)).alias("token_ids"), longest.alias("padded_to")).withColumn(
        "token_ids", F.concat("token_ids", F.array_repeat(F.lit(0).cast("bigint"), F.col("padded_to") - F.size("token_ids")))
    )


def token_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves' texts of each function as one sentence."""
    return trees.leaf_tokens(_nodes(spark, sf_dir)).select("fn_id", F.size("tokens").alias("n"), F.md5(F.concat_ws(" ", "tokens")).alias("digest"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = table(spark, sf_dir, "parse_info").dropDuplicates(["fn_id"])
    sizes = table(spark, sf_dir, "graph_samples").groupBy("fn_id").agg(F.max("num_nodes").alias("num_nodes"))
    return info.join(sizes, "fn_id", "left")


def _reason():
    """First of the reasons that holds (P3-P5); the parser's own verdict comes before the size."""
    share = F.when(F.col("total_bytes") > 0, F.col("error_bytes") / F.col("total_bytes")).otherwise(F.lit(0.0))
    return F.coalesce(F.col("reason"), F.when(~F.col("has_function_definition") | (share > 0.2), "parse").when(F.col("num_nodes") > trees.MAX_NODES, "size").otherwise("kept"))


def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and their share in percent for each reason they were dropped, or kept."""
    counted = _parsed(spark, sf_dir).groupBy(_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("reason", "n", (F.col("n") * 100.0 / F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy()))).alias("percent"))


def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with errors, the share of bytes in error and the usable ones (P3, P17, G2), by project."""
    names = table(spark, sf_dir, "raw_functions").select("fn_id", name_of("project").alias("project"))
    joined = _parsed(spark, sf_dir).join(names, "fn_id")
    total = F.sum("total_bytes")
    return joined.groupBy("project").agg(
        F.count(F.lit(1)).alias("functions"), F.count_if("has_error").alias("with_error"), F.count_if(_reason() == "kept").alias("kept"),
        F.when(total > 0, F.sum("error_bytes") * 1000.0 / total).otherwise(F.lit(0.0)).alias("error_permille"),
    )


def size_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of graphs of similar size under 128 graphs and 12,000 padded nodes."""
    graphs = table(spark, sf_dir, "graph_samples").groupBy("fn_id").agg(F.max("num_nodes").alias("num_nodes"))
    return splits.size_batches(graphs, "fn_id", "num_nodes", 128, 12_000).withColumnRenamed("id", "fn_id")


QUERIES = {f.__name__: f for f in (
    ast_edges, ncs_edges, identifier_roles, dfg_edges, cfg_edges, edge_counts, edge_norms, edge_norms_all, ablated_edges, edge_bounds, max_nesting, function_metrics,
    type_vocabulary, node_type_ids, token_vocabulary, token_counts, token_sequences, token_sequences_cut, token_sentences, drop_reasons, parse_quality, size_batches,
)}

_NODES = "nodes AS (SELECT DISTINCT ON (fn_id, node_id) * FROM ast_nodes)"
_AST = "SELECT fn_id, 'AST' AS etype, parent AS src, node_id AS dst FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT fn_id, 'REV_AST', node_id, parent FROM nodes WHERE parent IS NOT NULL"
_NCS = """SELECT fn_id, 'NCS' AS etype, node_id AS src, dst FROM (
    SELECT fn_id, node_id, lead(node_id) OVER (PARTITION BY fn_id ORDER BY start_byte, node_id) AS dst FROM nodes WHERE is_leaf) WHERE dst IS NOT NULL"""
_ROLES = f"""
{_NODES}, firsts AS (
    SELECT fn_id, parent, min(node_id) AS first FROM nodes WHERE parent IS NOT NULL GROUP BY fn_id, parent
), climb(fn_id, ident, top, above) AS (
    SELECT fn_id, node_id, node_id, parent FROM nodes WHERE type = 'identifier'
    UNION ALL
    SELECT c.fn_id, c.ident, n.node_id, n.parent FROM climb c JOIN nodes n ON n.fn_id = c.fn_id AND n.node_id = c.above AND n.type IN ('pointer_declarator', 'array_declarator')
), tops AS (
    SELECT fn_id, ident, min(top) AS t FROM climb WHERE top <> ident GROUP BY fn_id, ident
), placed AS (
    SELECT n.fn_id, n.node_id, n.code, n.start_byte, n.parent, coalesce(t.t, n.node_id) AS top FROM nodes n LEFT JOIN tops t ON t.fn_id = n.fn_id AND t.ident = n.node_id WHERE n.type = 'identifier'
), roles AS (
    SELECT p.fn_id, p.node_id, p.code, p.start_byte, p.parent, p.top,
           CASE WHEN w.parent IS NULL THEN CASE WHEN p.top <> p.node_id THEN 'write' ELSE 'read' END
                WHEN u.type IN ('init_declarator', 'assignment_expression') THEN CASE WHEN f.first = p.top THEN 'write' ELSE 'read' END
                WHEN u.type IN ('update_expression', 'parameter_declaration', 'declaration') THEN 'write' ELSE 'read' END AS role
    FROM placed p JOIN nodes w ON w.fn_id = p.fn_id AND w.node_id = p.top
    LEFT JOIN nodes u ON u.fn_id = w.fn_id AND u.node_id = w.parent
    LEFT JOIN firsts f ON f.fn_id = w.fn_id AND f.parent = w.parent
)"""
_DFG = """
SELECT fn_id, 'DFG_R' AS etype, node_id AS src, r AS dst FROM seen WHERE role = 'read' AND r IS NOT NULL
UNION ALL SELECT fn_id, 'DFG_W', node_id, w FROM seen WHERE role = 'read' AND w IS NOT NULL
UNION ALL SELECT a.fn_id, 'DFG_C', a.node_id, b.node_id FROM roles a JOIN nodes p ON p.fn_id = a.fn_id AND p.node_id = a.parent AND p.type IN ('init_declarator', 'assignment_expression')
    JOIN firsts f ON f.fn_id = p.fn_id AND f.parent = p.node_id AND f.first = a.node_id
    JOIN nodes b ON b.fn_id = a.fn_id AND b.type = 'identifier' AND b.node_id > a.node_id AND b.node_id <= p.subtree_end"""
_SEEN = """seen AS (
    SELECT *, last_value(CASE WHEN role = 'read' THEN node_id END IGNORE NULLS) OVER w AS r, last_value(CASE WHEN role = 'write' THEN node_id END IGNORE NULLS) OVER w AS w
    FROM roles WHERE code IS NOT NULL WINDOW w AS (PARTITION BY fn_id, code ORDER BY start_byte, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
_LEAVES = f"{_NODES}, leaves AS (SELECT n.fn_id, node_id, start_byte, code, split, target FROM nodes n JOIN raw_functions f ON f.fn_id = n.fn_id WHERE is_leaf AND code IS NOT NULL)"
_TOKENS = """vocab AS (
    SELECT code AS token, row_number() OVER (ORDER BY f, s, k) + 1 AS token_id FROM (
        SELECT code, fn_id AS f, start_byte AS s, node_id AS k, row_number() OVER (PARTITION BY code ORDER BY fn_id, start_byte, node_id) AS nth FROM leaves WHERE split = 'train') WHERE nth = 1
)"""
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIMMED = f"regexp_replace(regexp_replace(project, '^{_SPACE}+', ''), '{_SPACE}+$', '')"
_PARSED = """parsed AS (
    SELECT i.*, num_nodes, CASE WHEN total_bytes > 0 THEN error_bytes / total_bytes ELSE 0 END AS share
    FROM (SELECT DISTINCT ON (fn_id) * FROM parse_info) i LEFT JOIN (SELECT fn_id, max(num_nodes) AS num_nodes FROM graph_samples GROUP BY fn_id) s USING (fn_id)
), verdict AS (
    SELECT *, coalesce(reason, CASE WHEN NOT has_function_definition OR share > 0.2 THEN 'parse' WHEN num_nodes > 500 THEN 'size' ELSE 'kept' END) AS why FROM parsed
)"""
_SIZED = """nodes AS (SELECT * EXCLUDE (c) FROM (SELECT *, count(*) OVER (PARTITION BY fn_id) AS c FROM (SELECT DISTINCT ON (fn_id, node_id) * FROM ast_nodes)) WHERE c <= 500)"""

ORACLE_SQL = {
    "ast_edges": f"WITH {_NODES} {_AST}",
    "ncs_edges": f"WITH {_NODES} {_NCS}",
    "identifier_roles": f"WITH RECURSIVE {_ROLES} SELECT fn_id, node_id, role FROM roles",
    "dfg_edges": f"WITH RECURSIVE {_ROLES}, {_SEEN} {_DFG}",
    "edge_norms": f"""
WITH RECURSIVE {_ROLES.replace(_NODES, _SIZED)}, {_SEEN}, edges AS (
    {_AST} UNION ({_NCS}) UNION ({_DFG})
    UNION SELECT fn_id, unnest(['AST', 'REV_AST', 'NCS', 'DFG_R', 'DFG_W', 'DFG_C']), node_id, node_id FROM nodes
)
SELECT fn_id, etype, src, dst, 1.0 / count(*) OVER (PARTITION BY fn_id, etype, src) AS norm FROM (SELECT DISTINCT * FROM edges)""",
    "ablated_edges": f"""
WITH RECURSIVE {_ROLES}, {_SEEN}, edges AS ({_AST} UNION ({_NCS}) UNION ({_DFG}))
SELECT DISTINCT fn_id, CAST(list_position(['AST', 'NCS', 'DFG_W'], etype) - 1 AS INTEGER) AS etype_id, src, dst FROM edges WHERE etype IN ('AST', 'NCS', 'DFG_W')""",
    "max_nesting": f"""
WITH {_NODES}, around AS (
    SELECT fn_id, node_id AS a, subtree_end AS z FROM nodes WHERE type IN ('for_statement', 'while_statement', 'do_statement', 'if_statement', 'case_statement', 'switch_statement')
), depth AS (
    SELECT n.fn_id, n.node_id, count(a.a) AS d FROM nodes n LEFT JOIN around a ON a.fn_id = n.fn_id AND a.a < n.node_id AND n.node_id <= a.z GROUP BY n.fn_id, n.node_id
)
SELECT fn_id, max(d) AS max_nesting FROM depth GROUP BY fn_id""",
    "type_vocabulary": f"""
WITH {_NODES} SELECT type, row_number() OVER (ORDER BY f, k) AS type_id FROM (
    SELECT type, fn_id AS f, node_id AS k, row_number() OVER (PARTITION BY type ORDER BY fn_id, node_id) AS nth FROM nodes WHERE type IS NOT NULL) WHERE nth = 1""",
    "node_type_ids": f"""
WITH {_NODES}, vocab AS (
    SELECT type, row_number() OVER (ORDER BY f, k) AS type_id FROM (
        SELECT type, fn_id AS f, node_id AS k, row_number() OVER (PARTITION BY type ORDER BY fn_id, node_id) AS nth FROM nodes WHERE type IS NOT NULL) WHERE nth = 1
)
SELECT fn_id, node_id, coalesce(type_id, 0) AS type_id FROM nodes LEFT JOIN vocab USING (type)""",
    "token_vocabulary": f"WITH {_LEAVES}, {_TOKENS} SELECT token, token_id FROM vocab",
    "token_counts": f"WITH {_LEAVES} SELECT code AS token, count(*) AS n FROM leaves GROUP BY code HAVING count(*) >= 3",
    "token_sequences": f"""
WITH {_LEAVES}, {_TOKENS}, placed AS (
    SELECT fn_id, target, split, coalesce(token_id, 1) AS t, row_number() OVER (PARTITION BY fn_id ORDER BY start_byte, node_id) AS k FROM leaves LEFT JOIN vocab ON token = code
)
SELECT fn_id, target, split, list(t ORDER BY k) AS token_ids FROM placed GROUP BY fn_id, target, split""",
    "token_sequences_cut": f"""
WITH {_LEAVES}, {_TOKENS}, placed AS (
    SELECT fn_id, target, split, coalesce(token_id, 1) AS t, row_number() OVER (PARTITION BY fn_id ORDER BY start_byte, node_id) AS k FROM leaves LEFT JOIN vocab ON token = code
), cut AS (
    SELECT fn_id, target, split, list(t ORDER BY k) AS ids FROM placed WHERE k <= 500 GROUP BY fn_id, target, split
), padded AS (
    SELECT *, max(len(ids)) OVER (PARTITION BY split)::INTEGER AS padded_to FROM cut
)
SELECT fn_id, target, split, list_resize(ids, padded_to, 0) AS token_ids, padded_to FROM padded""",
    "token_sentences": f"WITH {_NODES} SELECT fn_id, count(*)::INTEGER AS n, md5(string_agg(code, ' ' ORDER BY start_byte, node_id)) AS digest FROM nodes WHERE is_leaf AND code IS NOT NULL GROUP BY fn_id",
    "drop_reasons": f"WITH {_PARSED} SELECT why AS reason, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM verdict GROUP BY why",
    "parse_quality": f"""
WITH {_PARSED} SELECT coalesce(lower({_TRIMMED}), '') AS project, count(*) AS functions, count(*) FILTER (WHERE has_error) AS with_error, count(*) FILTER (WHERE why = 'kept') AS kept,
       CASE WHEN sum(total_bytes) > 0 THEN sum(error_bytes) * CAST(1000 AS DOUBLE) / sum(total_bytes) ELSE 0 END AS error_permille
FROM verdict v JOIN raw_functions f ON f.fn_id = v.fn_id GROUP BY 1""",
}
