"""Code graphs from syntax trees: typed edges, reads and writes, nesting, metrics, vocabularies.

Input rows are (fn_id, node_id, type, code, start_byte, end_byte, is_leaf, parent, subtree_end) in pre-order numbering.
``clean`` keeps one row of each node and drops nothing else. Ancestors and descendants are found by the interval
[node_id, subtree_end], always together with the equality of fn_id, so that Spark hashes on the function and never
builds a nested loop over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ranking import number_cell, spread_rank
from lodestrata.session import materialize, ship_package

EDGE_TYPES = ["AST", "REV_AST", "CFG", "NCS", "DFG_R", "DFG_W", "DFG_C"]
LOOPS = ["for_statement", "while_statement", "do_statement"]
BRANCHES = ["if_statement", "case_statement", "switch_statement"]
ALLOCATORS = ["malloc", "calloc", "realloc", "alloca"]
MAX_NODES = 500


def clean(nodes: DataFrame) -> DataFrame:
    """One row for each (fn_id, node_id); repeated deliveries are equal copies."""
    return nodes.dropDuplicates(["fn_id", "node_id"])


def sized(nodes: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """Only trees of at most ``max_nodes`` nodes."""
    n = F.count(F.lit(1)).over(Window.partitionBy("fn_id"))
    return nodes.withColumn("__n", n).filter(F.col("__n") <= max_nodes).drop("__n")


def ast_edges(nodes: DataFrame) -> DataFrame:
    """(fn_id, etype, src, dst): parent to child and back."""
    child = nodes.filter("parent IS NOT NULL")
    both = F.explode(F.array(F.struct(F.lit("AST").alias("etype"), F.col("parent").alias("src"), F.col("node_id").alias("dst")), F.struct(F.lit("REV_AST").alias("etype"), F.col("node_id").alias("src"), F.col("parent").alias("dst"))))
    return child.select("fn_id", both.alias("e")).select("fn_id", "e.*")


def next_token_edges(nodes: DataFrame) -> DataFrame:
    """Each leaf to the next one in the source."""
    w = Window.partitionBy("fn_id").orderBy("start_byte", "node_id")
    leaves = nodes.filter("is_leaf").withColumn("dst", F.lead("node_id").over(w))
    return leaves.filter("dst IS NOT NULL").select("fn_id", F.lit("NCS").alias("etype"), F.col("node_id").alias("src"), "dst")


def identifiers(nodes: DataFrame) -> DataFrame:
    """(fn_id, node_id, code, start_byte, role, target_end): identifiers with their role (P12); ``target_end`` is the end
    of the assignment or initialiser that sets the identifier directly, null elsewhere.

    A node's first child is the next one in pre-order. A declarator of a pointer or array passes the question on to its
    own parent, so the chain of such wrappers is followed among the nested wrappers alone, whose links double their reach
    with each join until all have reached the outermost one. Identifiers meet their parents in one join, and their wrappers
    in another; what several joins read is written once.
    """
    holders = nodes.filter(F.col("type").isin(*SETTERS, *DECLARERS, *WRAPPERS)).select(F.col("fn_id").alias("pf"), F.col("node_id").alias("pid"), F.col("type").alias("ptype"), F.col("subtree_end").alias("pend"))
    asked = nodes.filter(F.col("type").isin("identifier", *WRAPPERS)).select("fn_id", "node_id", "type", "code", "start_byte", "parent")
    asked = materialize(asked.join(holders, (F.col("fn_id") == F.col("pf")) & (F.col("parent") == F.col("pid")), "left").drop("pf", "pid"), "asked")
    # (wf, wid, wtop, wparent, wptype): each wrapper with the outermost one of its chain, and that one's parent
    wraps = asked.filter(F.col("type") != "identifier").select(F.col("fn_id").alias("wf"), F.col("node_id").alias("wid"), F.col("node_id").alias("wtop"), F.col("parent").alias("wparent"), F.col("ptype").alias("wptype"))
    inner = F.coalesce(F.col("wptype").isin(*WRAPPERS), F.lit(False))
    while not wraps.filter(inner).isEmpty():
        further = wraps.select(*[F.col(c).alias(f"x{c}") for c in wraps.columns])
        step = wraps.filter(inner).join(further, (F.col("wf") == F.col("xwf")) & (F.col("wparent") == F.col("xwid")), "left")
        step = step.select("wf", "wid", F.coalesce("xwtop", "wtop").alias("wtop"), F.col("xwparent").alias("wparent"), F.col("xwptype").alias("wptype"))
        wraps = materialize(wraps.filter(~inner).unionByName(step), "wraps")
    ident = asked.filter("type = 'identifier'").join(wraps, (F.col("fn_id") == F.col("wf")) & (F.col("parent") == F.col("wid")), "left")
    wrapped = F.col("wid").isNotNull()
    top, above, kind = (F.when(wrapped, F.col(w)).otherwise(F.col(o)) for w, o in (("wtop", "node_id"), ("wparent", "parent"), ("wptype", "ptype")))
    role = (
        F.when(above.isNull(), F.when(wrapped, "write").otherwise("read"))
        .when(kind.isin(*SETTERS), F.when(top == above + 1, "write").otherwise("read"))
        .when(kind.isin(*DECLARERS), "write")
        .otherwise("read")
    )
    target = F.when(F.col("ptype").isin(*SETTERS) & (F.col("node_id") == F.col("parent") + 1), F.col("pend"))
    return ident.select("fn_id", "node_id", "code", "start_byte", role.alias("role"), target.alias("target_end"))


SETTERS = ["init_declarator", "assignment_expression"]
DECLARERS = ["update_expression", "parameter_declaration", "declaration"]
WRAPPERS = ["pointer_declarator", "array_declarator"]


def data_flow_edges(nodes: DataFrame) -> DataFrame:
    """DFG_R and DFG_W from each read to the last read and write of the variable before it; DFG_C from the variable an
    assignment or initialiser sets to every identifier on its right (G6)."""
    ident = materialize(identifiers(nodes), "identifiers")
    before = Window.partitionBy("fn_id", "code").orderBy("start_byte", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("node_id")), ignorenulls=True).over(before)
    reads = ident.filter("code IS NOT NULL").withColumn("r", last("read")).withColumn("w", last("write")).filter("role = 'read'")
    pair = F.explode(F.array(F.struct(F.lit("DFG_R").alias("etype"), F.col("r").alias("dst")), F.struct(F.lit("DFG_W").alias("etype"), F.col("w").alias("dst"))))
    back = reads.select("fn_id", F.col("node_id").alias("src"), pair.alias("e")).select("fn_id", "e.etype", "src", "e.dst").filter("dst IS NOT NULL")
    # right-hand sides: what follows the identifier in the subtree of what sets it
    targets = ident.filter("target_end IS NOT NULL").select("fn_id", F.col("node_id").alias("src"), "target_end")
    inner = ident.select(F.col("fn_id").alias("f"), F.col("node_id").alias("dst"))
    right = targets.join(inner, (F.col("fn_id") == F.col("f")) & (F.col("dst") > F.col("src")) & (F.col("dst") <= F.col("target_end")))
    return back.unionByName(right.select("fn_id", F.lit("DFG_C").alias("etype"), "src", "dst"))


def nesting(nodes: DataFrame) -> DataFrame:
    """(fn_id, max_nesting): largest number of loops and branches around any node."""
    around = nodes.filter(F.col("type").isin(*LOOPS, *BRANCHES)).select(F.col("fn_id").alias("f"), F.col("node_id").alias("a"), F.col("subtree_end").alias("z"))
    # only deepest places matter: starts and ends of the enclosing intervals, as +1 and -1 events in pre-order
    inside = around.filter("z > a")
    events = inside.select(F.col("f").alias("fn_id"), (F.col("a") + 1).alias("at"), F.lit(1).alias("d")).unionByName(inside.select(F.col("f").alias("fn_id"), (F.col("z") + 1).alias("at"), F.lit(-1).alias("d")))
    depth = events.groupBy("fn_id", "at").agg(F.sum("d").alias("d")).withColumn("depth", F.sum("d").over(Window.partitionBy("fn_id").orderBy("at")))
    return nodes.select("fn_id").distinct().join(depth.groupBy("fn_id").agg(F.max("depth").alias("m")), "fn_id", "left").select("fn_id", F.coalesce("m", F.lit(0)).cast("bigint").alias("max_nesting"))


def flow_of(types: list, codes: list, parents: list) -> list[tuple[int, int]]:
    """Control-flow edges of one function's tree, given by pre-order number.

    Two passes: first, from the leaves up, where control enters each statement (None: an empty block, which control
    passes by); then, from the root down, where it goes after each statement, with the targets of break and continue.
    """
    n = len(types)
    kids: list[list[int]] = [[] for _ in range(n)]
    for k, p in enumerate(parents):
        if p is not None:
            kids[p].append(k)
    root = next((k for k in range(n) if types[k] == "function_definition"), None)
    body = next((c for c in kids[root] if types[c] == "compound_statement"), None) if root is not None else None
    if body is None:
        return []
    statement = {"compound_statement", "return_statement", "break_statement", "continue_statement", "expression_statement", "declaration", "labeled_statement", "goto_statement", "if_statement", "switch_statement", *LOOPS}
    shape: dict[int, tuple] = {}
    entry: list[int | None] = list(range(n))

    def named(k: int, *names: str) -> int | None:
        return next((c for c in kids[k] if types[c] in names), None)

    def block(of: list[int]) -> int | None:
        return next((entry[c] for c in of if entry[c] is not None), None)

    for k in range(n - 1, -1, -1):
        t = types[k]
        if t == "compound_statement":
            entry[k] = block(kids[k])
        elif t == "if_statement":
            test = named(k, "parenthesized_expression")
            arms = [c for c in kids[k] if c != test and types[c] not in ("if", "else")]
            alternative = arms[1] if len(arms) > 1 else None
            if alternative is not None and types[alternative] == "else_clause":
                alternative = next((c for c in kids[alternative] if types[c] != "else"), None)
            entry[k] = k if test is None else test
            shape[k] = (entry[k], [c for c in (arms[:1] + [alternative]) if c is not None], len(arms) < 2)
        elif t == "while_statement":
            tests = [c for c in kids[k] if types[c] == "parenthesized_expression"]
            rest = [c for c in kids[k] if types[c] not in ("parenthesized_expression", "while")]
            entry[k] = tests[-1] if tests else k
            shape[k] = (entry[k], rest[-1] if rest else None)
        elif t == "for_statement":
            parts = [c for c in kids[k] if types[c] != "for"]
            head = parts[:-1]
            entry[k] = (head[0] if head else k) if parts else None
            shape[k] = (head, parts[-1] if parts else None)
        elif t == "do_statement":
            parts = [c for c in kids[k] if types[c] not in ("do", "while", "for")]
            test = next((c for c in parts if types[c] == "parenthesized_expression"), k)
            first = entry[parts[0]] if parts else None
            entry[k] = test if first is None else first
            shape[k] = (test, parts[0] if parts else None)
        elif t == "switch_statement":
            test, inside = named(k, "parenthesized_expression"), named(k, "compound_statement")
            entry[k] = k if test is None else test
            cases = []
            for c in kids[inside] if inside is not None else []:
                steps = [c]
                if types[c] == "case_statement":
                    steps = [x for x in kids[c] if types[x] not in ("case", "default")]
                    label = next((i for i, x in enumerate(steps) if types[x] not in statement), None)
                    if label is not None:
                        del steps[label]
                at = block(steps)
                cases.append((steps, c if at is None else at))
            shape[k] = (entry[k], cases)
        elif t == "labeled_statement":
            shape[k] = (next((c for c in kids[k] if types[c] != "statement_identifier"), None),)

    labels = {}
    for k in range(n):
        if types[k] == "labeled_statement" and (name := named(k, "statement_identifier")) is not None:
            labels[codes[name]] = k
    out: list[tuple[int, int]] = []

    def link(a: int, b: int | None) -> None:
        if b is not None:
            out.append((a, b))

    todo: list[tuple[int, int | None, int | None, int | None]] = [(body, None, None, None)]

    def series(of: list[int], after: int | None, leave: int | None, again: int | None) -> None:
        for c in reversed(of):
            if entry[c] is not None:
                todo.append((c, after, leave, again))
                after = entry[c]

    while todo:
        k, after, leave, again = todo.pop()
        t = types[k]
        if t == "compound_statement":
            series(kids[k], after, leave, again)
        elif t == "if_statement":
            test, arms, open_end = shape[k]
            for arm in arms:
                if entry[arm] is not None:
                    link(test, entry[arm])
                    todo.append((arm, after, leave, again))
            if open_end:
                link(test, after)
        elif t in ("while_statement", "do_statement", "for_statement"):
            test, inner = shape[k]
            if t == "for_statement":
                for a, b in zip(test, test[1:], strict=False):
                    link(a, b)
                test = test[-1] if test else k
            if t == "do_statement":
                link(test, entry[k])
            elif inner is not None:
                link(test, entry[inner])
            if inner is not None and entry[inner] is not None:
                todo.append((inner, test, after, test))
            link(test, after)
        elif t == "switch_statement":
            test, cases = shape[k]
            for i, (steps, at) in enumerate(cases):
                link(test, at)
                series(steps, cases[i + 1][1] if i + 1 < len(cases) else after, after, again)
            if not cases:
                link(test, after)
        elif t == "labeled_statement":
            inner = shape[k][0]
            if inner is None:
                link(k, after)
            elif entry[inner] is not None:
                link(k, entry[inner])
                todo.append((inner, after, leave, again))
        elif t == "goto_statement":
            name = named(k, "statement_identifier")
            link(k, labels.get(codes[name]) if name is not None else None)
        elif t == "break_statement":
            link(k, leave)
        elif t == "continue_statement":
            link(k, again)
        elif t != "return_statement":
            link(k, after)
    return out


def control_flow_edges(nodes: DataFrame) -> DataFrame:
    """(fn_id, etype, src, dst) of the control flow (G5). A function's tree is one group; trees are independent of each other."""
    ship_package(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: list[tuple]) -> tuple[list, list, list]:
            number = {r[1]: k for k, r in enumerate(rows)}
            got = flow_of([r[2] for r in rows], [r[3] for r in rows], [number.get(r[4]) for r in rows])
            return [rows[0][0]] * len(got), [rows[a][1] for a, _ in got], [rows[b][1] for _, b in got]

        def batch_of(parts: list[tuple]) -> pa.RecordBatch:
            f, s, d = ([x for p in parts for x in p[i]] for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(["CFG"] * len(f), pa.string()), pa.array(s, pa.int32()), pa.array(d, pa.int32())], names=["fn_id", "etype", "src", "dst"])

        tree, parts = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tree and row[0] != tree[0][0]:
                    parts.append(edges(tree))
                    tree = []
                tree.append(row)
            if parts:
                yield batch_of(parts)
                parts = []
        if tree:
            yield batch_of([edges(tree)])

    # only types and labels matter to control flow
    slim = nodes.select(F.col("fn_id").cast("bigint"), "node_id", "type", F.when(F.col("type") == "statement_identifier", F.col("code")).alias("code"), "parent")
    return slim.repartition("fn_id").sortWithinPartitions("fn_id", "node_id").mapInArrow(run, "fn_id bigint, etype string, src int, dst int")


def all_edges(nodes: DataFrame) -> DataFrame:
    """Edges of all seven types, repeated ones kept."""
    return ast_edges(nodes).unionByName(control_flow_edges(nodes)).unionByName(next_token_edges(nodes)).unionByName(data_flow_edges(nodes))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each (fn_id, etype, src, dst) once."""
    return edges.dropDuplicates(["fn_id", "etype", "src", "dst"])


def edge_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fn_id, etype, n) with a row for every type of every function, repeated edges counted."""
    kinds = nodes.select("fn_id").distinct().withColumn("etype", F.explode(F.array(*[F.lit(t) for t in EDGE_TYPES])))
    counted = edges.groupBy("fn_id", "etype").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counted, ["fn_id", "etype"], "left").fillna(0, ["n"])


def edges_outside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fn_id, etype, outside): ends of edges that name a node their function doesn't have, by type; types beyond ``EDGE_TYPES`` count with both ends."""
    ends = edges.select("fn_id", "etype", F.explode(F.array("src", "dst")).alias("node_id"))
    known = nodes.select("fn_id", "node_id", F.lit(True).alias("known"))
    bad = ends.join(known, ["fn_id", "node_id"], "left").filter(F.col("known").isNull() | F.col("etype").isNull() | ~F.col("etype").isin(*EDGE_TYPES))
    return bad.groupBy("fn_id", "etype").agg(F.count(F.lit(1)).alias("outside"))


def edge_weights(edges: DataFrame, nodes: DataFrame, self_loops: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """Distinct edges with self-loops of every type (or of ``kinds``) and ``norm`` = 1 / out-degree of (etype, src)."""
    e = distinct_edges(edges)
    if self_loops:
        loops = nodes.withColumn("etype", F.explode(F.array(*[F.lit(t) for t in kinds or EDGE_TYPES]))).select("fn_id", "etype", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
        e = distinct_edges(e.unionByName(loops))
    return e.withColumn("norm", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("fn_id", "etype", "src")))


def function_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The 15 metrics of each function (A10): one pass over nodes, one over edges, joined on fn_id."""
    t = F.col("type")
    has = lambda *names: F.count_if(t.isin(*names))
    n = nodes.groupBy("fn_id").agg(
        F.count(F.lit(1)).alias("num_nodes"), has(*LOOPS).alias("num_loops"), has(*BRANCHES).alias("num_branches"), has("call_expression").alias("num_calls"),
        has("return_statement").alias("num_returns"), has("assignment_expression").alias("num_assignments"), has("pointer_declarator", "pointer_expression").alias("num_pointers"),
        F.count_if(F.col("code").isin(*ALLOCATORS)).alias("num_alloc"), F.count_if(F.col("code") == "free").alias("num_free"), has("identifier").alias("num_identifiers"),
    )
    e = F.col("etype")
    g = edges.groupBy("fn_id").agg(F.count_if(e == "AST").alias("num_ast_edges"), F.count_if(e == "CFG").alias("num_cfg_edges"), F.count_if(e.startswith("DFG")).alias("num_dfg_edges"))
    out = n.join(g, "fn_id", "left").join(nesting(nodes), "fn_id", "left").fillna(0).withColumn("cyclomatic", F.col("num_loops") + F.col("num_branches") + 1)
    return out.select("fn_id", *METRIC_NAMES)


METRIC_NAMES = [
    "num_nodes", "num_ast_edges", "num_cfg_edges", "num_dfg_edges", "cyclomatic", "max_nesting", "num_loops", "num_branches",
    "num_calls", "num_returns", "num_assignments", "num_pointers", "num_alloc", "num_free", "num_identifiers",
]


def vocabulary(rows: DataFrame, term_col: str, order: list[str], first_id: int, name: str) -> DataFrame:
    """(term, id): terms numbered from ``first_id`` in the order in which they first appear.

    First appearances are minima per term; only distinct terms are ranked, in ranges of the first column of ``order``
    (a number), so that no task sorts the whole vocabulary.
    """
    firsts = rows.filter(F.col(term_col).isNotNull()).groupBy(F.col(term_col).alias("term")).agg(F.min(F.struct(*order)).alias("first"))
    firsts = materialize(firsts, "terms")
    at = F.col("first")[order[0]]
    low, high = firsts.agg(F.min(at), F.max(at)).first()
    ranked = spread_rank(firsts, [], ["first"], number_cell(at, low or 0, high or 0), "rank")
    return ranked.select("term", (F.col("rank") + F.lit(first_id - 1)).cast("bigint").alias(name))


def leaf_tokens(nodes: DataFrame) -> DataFrame:
    """(fn_id, tokens): the leaves' texts of each function in source order."""
    leaves = nodes.filter("is_leaf AND code IS NOT NULL")
    return leaves.groupBy("fn_id").agg(F.expr("transform(array_sort(collect_list(struct(start_byte, node_id, code))), x -> x.code)").alias("tokens"))
