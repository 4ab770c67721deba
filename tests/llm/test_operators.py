"""The training-data operators against brute force, on small inputs with nulls, ties, copies, long texts and extra columns."""

from __future__ import annotations

import itertools
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import encode, eval_leaks, format_duplicates, group_splits, packing, proportional_sample, queries, shared_spans, split_overlap, term_counts

NAMES = "head emit port digest trunk arena entry budget lock page table chunk".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(NAMES) + str(rng.randint(0, 30)) for _ in range(n))


# 1: formatting


def dup_rows(spark, rows, **kw):
    df = spark.createDataFrame(rows, "origin string, id bigint, func string, label string, bucket string, canon string")
    groups, members = format_duplicates.format_groups(df, **kw)
    return sorted(map(tuple, format_duplicates.duplicate_rows(groups, members).collect())), groups.collect()


@pytest.mark.parametrize("bucket_bytes,first", [(format_duplicates.BUCKET_BYTES, 6), (300, 1), (1, 2)])
def test_formatting_duplicates(spark, bucket_bytes, first):
    rng = random.Random(3)
    texts = ["int f() { return 1; }", "INT  F ( )\n{return_1;}", "int g() { return 1; }", None, "", " ;; ", "int f", "intf", "Ünï 北京 1", "ünÏ北京1", "x" * 50_000, "X " * 50_000]
    texts += [sentence(rng, 3) for _ in range(60)] + ["same text"] * 400
    rows = [(rng.choice("ab"), i, t, rng.choice(["0", "1", None]), "b", "c") for i, t in enumerate(texts)]
    expected = defaultdict(list)
    for origin, i, t, label, *_ in rows:
        key = "".join(c for c in (t or "").lower() if c.isalpha() or c.isdecimal())
        if key and label is not None:
            expected[origin, label, key].append(i)
    got, groups = dup_rows(spark, rows, bucket_bytes=bucket_bytes, first_bytes=first)
    assert got == sorted((k[0], min(v), d) for k, v in expected.items() for d in v if d != min(v))
    assert sorted((g["origin"], g["keep_id"], g["copies"]) for g in groups) == sorted((k[0], min(v), len(v)) for k, v in expected.items())


def test_formatting_empty(spark):
    assert dup_rows(spark, [])[0] == []


def test_payload_labels(spark):
    rows = [
        (1, json.dumps({"func": "a", "target": True})), (2, json.dumps({"code": "a", "label": "1"})), (3, json.dumps({"func": "", "function": "a", "target": 1.0})),
        (4, '{"func": "a", "targ'), (5, "null"), (6, None), (7, json.dumps({"func": "a"})), (8, json.dumps({"func": "a", "target": None, "label": False})), (9, json.dumps({"func": 5, "target": 1})),
    ]
    got = {r["id"]: (r["func"], r["label"]) for r in format_duplicates.parse_payloads(spark.createDataFrame(rows, "record_id bigint, payload string"), "record_id", "payload").collect()}
    assert got == {1: ("a", "1"), 2: ("a", "1"), 3: ("a", "1"), 4: (None, None), 5: (None, None), 6: (None, None), 7: ("a", None), 8: ("a", "0"), 9: (None, "1")}


# 2: packing


@pytest.mark.parametrize("segments,loss", [(None, None), (3, None), (None, 40), (2, 30)])
def test_packing(spark, segments, loss):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 3, 5, 30, 64, 65, 129, 500, None, 0, -1]), rng.choice([0, 1, None]), "x") for i in range(300)]
    rows += rows[:20] + [(None, 5, 1, "x")]
    graphs = spark.createDataFrame(rows, "fn_id bigint, num_nodes int, label int, nodes string")
    budgets = spark.createDataFrame([("s", 64), ("l", 200)], "budget_name string, max_nodes int")
    items = packing.items_of(graphs, "fn_id", "num_nodes", "label")
    placed = packing.pack(items, budgets, segments, loss).collect()
    bears = {r[0]: r[2] is not None for r in rows}
    sizes = {r[0]: r[1] for r in rows if r[0] is not None and (r[1] or 0) > 0}
    for name, cap in (("s", 64), ("l", 200)):
        own = [r for r in placed if r["budget_name"] == name]
        total, boxes, pieces = Counter(), defaultdict(list), Counter()
        for r in own:
            total[r["id"]] += r["nodes"]
            pieces[r["id"]] += 1
            boxes[r["container_id"]].append(r)
        assert total == sizes
        for i, n in pieces.items():
            assert (n > 1) == (sizes[i] > cap)
        for b in boxes.values():
            assert sum(r["nodes"] for r in b) <= cap
            assert len(b) <= (segments or cap)
            bearing = [r["nodes"] for r in b if bears[r["id"]]]
            assert sum(bearing) <= (loss or cap) or len(bearing) == 1
        assert set(boxes) == set(range(len(boxes)))
        if segments is None and loss is None:
            assert len(boxes) <= -(-sum(sizes.values()) // cap) + 2


def test_patterns_follow_the_dot_product():
    """The choice between the longest of either kind is the largest dot product over all classes that fit."""
    rng = random.Random(16)
    for _ in range(200):
        cap = rng.randint(1, 40)
        limits = (cap, rng.randint(1, 12), rng.randint(1, cap))
        classes = sorted({(rng.randint(1, cap), rng.randint(0, 1)) for _ in range(rng.randint(1, 12))})
        size, loss = (np.array([c[k] for c in classes], np.int64) for k in (0, 1))
        count = np.array([rng.choice([1, 1, 2, 7, 100]) for _ in classes], np.int64)
        got = packing.plan_patterns(size, loss, count, limits)
        assert sum(times * np.bincount([c for c, n in used for _ in range(n)], minlength=len(classes)) for times, used in got).tolist() == count.tolist()
        vec = np.stack([size, np.ones_like(size), np.minimum(size, limits[2]) * loss], axis=1) / np.array(limits)
        weight = (vec * count[:, None]).sum(axis=0)
        left = count.copy()
        for times, used in got:
            own, room, have = Counter(), np.ones(3), left.copy()
            while True:
                fits = [k for k in range(len(classes)) if have[k] and (vec[k] <= room + 1e-9).all()]
                if not fits:
                    break
                score = {k: vec[k] @ (weight * room) for k in fits}
                # what was chosen is among the best
                k = next(k for k in sorted(fits, key=lambda k: (own[k] >= dict(used).get(k, 0), -score[k])))
                assert own[k] < dict(used)[k] and score[k] >= max(score.values()) - 1e-9 * max(score.values())
                own[k] += 1
                have[k] -= 1
                room = room - vec[k]
            assert own == Counter(dict(used))
            left -= times * np.bincount(list(own.elements()), minlength=len(classes))


def test_odd_budgets(spark):
    graphs = spark.createDataFrame([(1, 70, 1), (2, 5, None)], "fn_id bigint, num_nodes int, label int")
    budgets = spark.createDataFrame([("s", 64), ("s", 64), ("s", 128), (None, 64), ("none", 0), ("null", None)], "budget_name string, max_nodes int")
    placed = packing.pack(packing.items_of(graphs, "fn_id", "num_nodes", "label"), budgets)
    assert sorted((r["budget_name"], r["id"], r["nodes"]) for r in placed.collect()) == [("s", 1, 6), ("s", 1, 64), ("s", 2, 5)]
    assert [(r["budget_name"], r["nodes"], r["containers"]) for r in packing.fill_report(placed, budgets).collect()] == [("s", 75, 2)]


def test_packing_empty(spark):
    graphs = spark.createDataFrame([], "fn_id bigint, num_nodes int, label int")
    budgets = spark.createDataFrame([("s", 64)], "budget_name string, max_nodes int")
    assert packing.pack(packing.items_of(graphs, "fn_id", "num_nodes", "label"), budgets).count() == 0
    assert packing.pack(packing.items_of(graphs, "fn_id", "num_nodes", "label"), budgets.limit(0)).count() == 0


# 3: sample


def test_seats_are_smallest_priorities():
    rng = random.Random(2)
    for _ in range(60):
        cats = [(rng.randint(0, 40), rng.randint(0, 4), rng.randint(0, 30)) for _ in range(rng.randint(1, 8))]
        total = rng.randint(0, 80)
        rows = []
        for k, (s, m, n) in enumerate(cats):
            for r in range(1, n + 1):
                if r <= m:
                    rows.append((0, r, k))
                elif s:
                    rows.append((1, (r - 0.5) / s, k))
        want = Counter(k for *_, k in sorted(rows)[:total])
        assert proportional_sample.seats(cats, total) == [want[k] for k in range(len(cats))]


def test_sample_nulls_and_empty(spark):
    schema = "fn_id bigint, func string, target int, project string, rank int, seats int"
    rows = [(i, t, i % 2, p, 0, 0) for i, (t, p) in enumerate(itertools.product(["x", None, "", "  \t", "y"], [" A", "a\n", None, "b"] * 10))]
    targets = spark.createDataFrame([("a", 0, 500, 1), ("a", 1, 300, 1), ("b", 0, 100, 1), ("c", 1, 100, 2)], "project string, target int, share_permille int, min_rows int")
    usable, report, total = proportional_sample.plan_sample(spark.createDataFrame(rows, schema), targets)
    assert total == len(rows) // 10
    by = {(r["project"], r["target"]): r for r in report.collect()}
    assert by["c", 1]["usable"] == 0 and not by["c", 1]["met"] and by["a", 0]["met"]
    drawn = proportional_sample.draw(usable, report).collect()
    assert len(drawn) == total == sum(r["seats"] for r in by.values())
    assert len({r["fn_id"] for r in drawn}) == total and all(rows[r["fn_id"]][1] in ("x", "y") for r in drawn)
    again = targets.unionByName(targets).unionByName(spark.createDataFrame([("a", 0, 100, None), (None, 0, 500, 1), ("a", None, 5, 5), ("d", 1, None, None)], targets.schema))
    _, more, _ = proportional_sample.plan_sample(spark.createDataFrame(rows, schema), again)
    got = {(r["project"], r["target"]): r for r in more.collect()}
    assert {k: r for k, r in got.items() if k != ("d", 1)} == by and got["d", 1]["met"] and got["d", 1]["seats"] == 0
    odd = spark.createDataFrame([(None, "x", 0, "a", 0, 0)] * 20 + [(7, "x", 0, "a", 0, 0)] * 20, schema)
    usable, report, total = proportional_sample.plan_sample(odd, targets)
    assert total == 4 and proportional_sample.draw(usable, report).count() == 4
    usable, report, total = proportional_sample.plan_sample(spark.createDataFrame([], schema), targets)
    assert total == 0 and proportional_sample.draw(usable, report).count() == 0 and report.filter("NOT met").count() == 4


# 4: terms


def brute_terms(parts, max_n):
    occ, rec = Counter(), Counter()
    for p in parts:
        for n in range(1, max_n + 1):
            grams = [" ".join(p[k : k + n]) for k in range(len(p) - n + 1)]
            occ.update((g, n) for g in grams)
            rec.update({(g, n) for g in grams})
    return {k: (v, rec[k]) for k, v in occ.items()}


@pytest.mark.parametrize("max_n", [1, 3])
def test_word_counts(spark, max_n, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(50)] + [None, "", "é-x x", "A a", "a " * 3000]
    df = spark.createDataFrame([(t, "t") for t in texts], "func string, term string")
    got = {(r["term"], r["n"]): (r["occurrences"], r["records"]) for r in term_counts.count_words(df, "func", max_n).collect()}
    assert got == brute_terms([re.findall("[A-Za-z0-9_]+", t or "") for t in texts], max_n)


def test_suffix_array_is_sorted():
    rng = random.Random(3)
    for _ in range(100):
        symbols = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 40))], np.uint64)
        start = np.array(sorted(rng.sample(range(len(symbols)), rng.randint(1, len(symbols)))))
        depth = np.array([rng.randint(1, len(symbols) - s) for s in start.tolist()])
        texts = [tuple(symbols[s : s + d].tolist()) for s, d in zip(start.tolist(), depth.tolist())]
        order, common = term_counts.suffix_array(symbols, start, depth)
        assert [int(k) for k in order] == sorted(range(len(texts)), key=lambda k: (texts[k], k))
        for i in range(1, len(order)):
            a, b = texts[order[i - 1]], texts[order[i]]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[i] == same if a != b else common[i] >= same


def test_long_words_and_values_with_blanks(spark):
    words = ["a" * n for n in (7, 8, 9, 15, 16, 17, 300)] + ["a" * 16 + "b", "a" * 8 + "b"]
    texts = [" ".join(words), " . ".join(words[::-1]), words[3]]
    got = {(r["term"], r["n"]): (r["occurrences"], r["records"]) for r in term_counts.count_words(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 2).collect()}
    assert got == brute_terms([re.findall("[A-Za-z0-9_]+", t) for t in texts], 2)
    rows = [(1, 0, "a b"), (1, 1, "c"), (2, 0, "a"), (2, 1, "b c"), (3, 0, "\\ x"), (3, 1, "\\")]
    got = Counter((r["term"], r["n"], r["records"]) for r in term_counts.count_values(spark.createDataFrame(rows, "r bigint, o int, v string"), "r", "o", "v", 2).collect())
    assert got == Counter([("a b c", 2, 1), ("a b c", 2, 1), ("a b", 1, 1), ("c", 1, 1), ("a", 1, 1), ("b c", 1, 1), ("\\ x \\", 2, 1), ("\\ x", 1, 1), ("\\", 1, 1)])


def test_value_counts(spark):
    rng = random.Random(4)
    rows = [(f, k, rng.choice(["x", "y", "z", None])) for f in range(30) for k in range(rng.randint(0, 9))]
    again = rows + rows[::3]
    rng.shuffle(again)
    got = {(r["term"], r["n"]): (r["occurrences"], r["records"]) for r in term_counts.count_values(spark.createDataFrame(again, "r bigint, o int, v string"), "r", "o", "v", 2).collect()}
    parts = defaultdict(list)
    for f, _, v in rows:
        if v is not None:
            parts[f].append(v)
    assert got == brute_terms(parts.values(), 2)
    assert term_counts.count_values(spark.createDataFrame([], "r bigint, o int, v string"), "r", "o", "v").count() == 0


def test_runs_of_words_of_functions(spark):
    occurrences, functions = Counter(), Counter()
    for r in spark.read.parquet("/root/testdata/sf0.001/raw_functions.parquet").select("func").collect():
        words = re.findall("[A-Za-z0-9_]+", r["func"] or "")
        runs = [(" ".join(words[k : k + n]), n) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
        occurrences.update(runs)
        functions.update(set(runs))
    got = {(r["term"], r["n"]): (r["occurrences"], r["functions"]) for r in queries.p4_func_grams(spark, "/root/testdata/sf0.001").collect()}
    assert got == {t: (occurrences[t], functions[t]) for t in occurrences}


# 5: overlap across splits


def segments(t):
    w = [x.lower() for x in re.findall("[A-Za-z0-9_]+", t or "")]
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


@pytest.mark.parametrize("wide", [split_overlap.WIDE, 2])
def test_split_overlap(spark, wide):
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(8, 60)) for _ in range(25)]
    texts = list(base)
    for t in base:
        for _ in range(4):
            w = t.split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["new%d" % rng.randint(0, 99)], [w[k], "ins"]])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[k:] + w[:k]
            texts.append(rng.choice([" ", "\n", ";"]).join(w).swapcase())
    texts += [None, "", "a b", "one two three", "one two three", "a " * 5000]
    rows = [(i, t, rng.choice(["train", "val", "test", None]), 1) for i, t in enumerate(texts)]
    rows += [(900, base[0], "train", 1), (901, base[0], "test", 1), (902, base[0], "val", 1), (902, base[0], "val", 1)]
    df = spark.createDataFrame(rows, "fn_id bigint, func string, split string, same int")
    found = split_overlap.overlaps(df, wide=wide)
    got = sorted(map(tuple, split_overlap.all_pairs(found, df).collect()))
    expected = set()
    for a, b in itertools.product(rows, rows):
        if a[2] in ("val", "test") and b[2] == "train" and a[0] != b[0]:
            x, y = segments(a[1]), segments(b[1])
            if x and y and len(x & y) * 10 >= 7 * len(x | y):
                expected.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == sorted(expected)
    assert split_overlap.all_pairs(split_overlap.overlaps(df.limit(0)), df.limit(0)).count() == 0


def test_banded_distance():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
            d = row
        band = rng.randint(0, 12)
        assert split_overlap.banded_distance(np.array(a), np.array(b), band) == (d[-1] if d[-1] <= band else None)


def test_banded_indels():
    rng = random.Random(18)
    for _ in range(400):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(d[j - 1] if x == y else 1 + min(row[-1], d[j]))
            d = row
        band = rng.randint(0, 20)
        assert split_overlap.banded_indels(a, b, band) == (d[-1] if d[-1] <= band else None)
    # between canonical strings: the symbols that only one has
    for _ in range(100):
        a, b = (sorted(rng.sample(range(40), rng.randint(0, 30))) for _ in range(2))
        assert split_overlap.banded_indels(a, b, 80) == len(set(a) ^ set(b))


# 6: groups


def test_group_splits(spark):
    rng = random.Random(9)
    commits = ["%040x" % rng.getrandbits(160) for _ in range(60)]
    rows, named = [], []
    for i in range(300):
        own = rng.sample(commits, rng.choice([0, 1, 1, 1, 2]))
        texts = [rng.choice([c, c.upper(), c[: rng.randint(12, 20)]]) for c in own]
        named.append(own)
        rows.append((i, rng.choice([", ", " / ", "\n"]).join(texts) or rng.choice([None, "", "n/a", "unknown", "f" * 11, "0" * 41]), i % 2, "k"))
    seen = {c for r in rows for c in re.findall("[0-9a-f]{40}", (r[1] or "").lower())}
    named = [[c for c in own if c in seen] for own in named]
    root = {c: c for c in commits}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for own in named:
        for c in own[1:]:
            a, b = sorted((find(own[0]), find(c)))
            root[b] = a
    keys = {i: find(own[0]) for i, own in enumerate(named) if own}
    sizes = Counter(keys.values())
    df = spark.createDataFrame(rows, "fn_id bigint, commit_id string, target int, group_key string")
    groups = group_splits.entity_groups(group_splits.named_commits(df))
    assert {r["id"]: r["group_key"] for r in group_splits.tied_records(groups).collect()} == {i: k for i, k in keys.items() if sizes[k] > 1}
    targets = spark.createDataFrame([("train", 750), ("val", 125), ("test", 125)], "split string, share_permille int")
    odd = spark.createDataFrame([(None, None, 1, "k"), (None, commits[0], None, "k")], df.schema)
    assert len({r["split"] for r in group_splits.assign_splits(odd, group_splits.entity_groups(group_splits.named_commits(odd)), targets).collect()}) == 1
    got = group_splits.assign_splits(df, groups, targets).collect()
    assert len(got) == len(rows)
    of = defaultdict(set)
    for r in got:
        of[keys.get(r["id"], r["id"])].add(r["split"])
    assert all(len(v) == 1 for v in of.values())
    empty = df.limit(0)
    assert group_splits.assign_splits(empty, group_splits.entity_groups(group_splits.named_commits(empty)), targets).count() == 0


def test_odd_split_targets(spark):
    df = spark.createDataFrame([(i, None, i % 2) for i in range(200)], "fn_id bigint, commit_id string, target int")
    groups = group_splits.entity_groups(group_splits.named_commits(df))
    schema = "split string, share_permille int"
    targets = spark.createDataFrame([("a", 750), ("a", 100), ("b", 250), ("c", None), (None, 900), ("d", 0)], schema)
    assert Counter(r["split"] for r in group_splits.assign_splits(df, groups, targets).collect()) == {"a": 150, "b": 50}
    with pytest.raises(ValueError):
        group_splits.assign_splits(df, groups, spark.createDataFrame([], schema))


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([("%03d" % a, "%03d" % b) for a, b in zip(order, order[1:])], "a string, b string")
    got = {r["node"]: r["root"] for r in group_splits.components(edges).collect()}
    assert got == {"%03d" % k: "000" for k in range(1, n)}


# 7: encoding


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(6)
    alphabet = " '  sretvmld'ab1\n\t\xa0.,é語😀\x00\x85　​²Ⅷ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["<|endoftext|>", "it's we'll 's", "a" * 3000, "日本語" * 200, "  \r\n ", "'", "x'", "I'LL", "word " * 20_000, None, "", "same", "same"]
    df = spark.createDataFrame([(i, x, [0]) for i, x in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_table(df, "doc_id", "text").collect()}
    assert got == {i: (t.encode(x, add_special_tokens=False).ids if x else []) for i, x in enumerate(texts)}
    assert encode.encode_table(df.limit(0), "doc_id", "text").count() == 0


def test_words_of_equal_hash_keep_their_own_ids():
    """The two Thue-Morse words of 2,048 letters have the same polynomial hash modulo 2^64."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    merges = encode.read_merges(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    alone = [encode.WordEncoder(merges).encode([w])[1].tolist() for w in (a, b)]
    assert alone[0] != alone[1]
    both = encode.WordEncoder(merges)
    for _ in range(2):  # learnt, then known
        offsets, ids = both.encode([a, "x " + b + " y", b])
        got = [ids[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:])]
        assert got[0] == alone[0] and got[2] == alone[1]
        assert got[1] == encode.WordEncoder(merges).encode(["x " + b + " y"])[1].tolist()


def test_merges_that_are_contracted_one_at_a_time():
    """Against one leftmost contraction after another, with merge tables in which a token has several sources."""
    rng = random.Random(14)
    for _ in range(40):
        pairs, names = [], ["a", "b", "c"]
        for _ in range(12):
            x, y = rng.choice(names), rng.choice(names)
            if (x, y) not in pairs:
                pairs.append((x, y))
                names += [x + y] if x + y not in names else []
        rng.shuffle(pairs)
        number = {t: k for k, t in enumerate(names)}
        byte_id = np.zeros(256, np.int32)
        for c in "abc":
            byte_id[ord(c)] = number[c]
        arrays = [np.array([number[f(p)] for p in pairs], np.int32) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1])]
        encoder = encode.WordEncoder(dict(zip(("left", "right", "merged"), arrays, strict=True)) | {"byte_id": byte_id, "classes": encode.char_classes()})
        words = ["".join(rng.choice("aab" if k % 2 else "abc") for _ in range(rng.randint(1, 30))) for k in range(20)]
        for word, got in zip(words, encoder.learn(words), strict=True):
            toks = list(word)
            while found := [(pairs.index(p), k) for k, p in enumerate(zip(toks, toks[1:])) if p in pairs]:
                k = min(found)[1]
                toks[k : k + 2] = [toks[k] + toks[k + 1]]
            assert got == [number[t] for t in toks]


# 8: leaks


def test_eval_leaks(spark):
    rng = random.Random(10)
    items = [(i, sentence(rng, rng.randint(1, 30))) for i in range(20)] + [(20, None), (21, ""), (22, "--"), (23, "stock prompt of twelve words that many items all begin with here now " + sentence(rng, 9))]
    docs = []
    for i in range(150):
        _, t = items[rng.randrange(20)]
        w = t.split()
        k = rng.randrange(len(w))
        part = w[k : k + rng.randint(1, 20)] if rng.random() < 0.5 else list(w)
        if rng.random() < 0.4 and len(part) > 3:
            part[rng.randrange(len(part))] = "edited"
        docs.append((i, (sentence(rng, 20) + " " + rng.choice([" ", ", ", "\n"]).join(part).upper() + "; " + sentence(rng, 20)), i))
    docs += [(200, None, 0), (201, "", 0), (202, docs[0][1], 0), (203, "stock prompt of twelve words that many items all begin with here now", 0), (204, "head " * 20_000, 0)]
    words = lambda t: [x.lower() for x in re.findall("[A-Za-z0-9_]+", t or "")]
    expected = set()
    for i, t in items:
        w = words(t)
        n = min(12, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for d, x, _ in docs:
            y = words(x)
            if n and any(tuple(y[k : k + n]) in grams for k in range(len(y) - n + 1)):
                expected.add((d, i))
    found = eval_leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {tuple(r) for r in eval_leaks.leaked(found).collect()} == expected
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert eval_leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), none).count() == 0


def smith_waterman(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_edited_copies_are_aligned(spark):
    rng = random.Random(12)
    items = {i: [f"w{i}x{k}" for k in range(n)] for i, n in enumerate([40, 12, 12, 24, 9, 3])} | {6: ["again", "and"] * 10}
    noise = lambda n: [f"n{rng.randrange(500)}" for _ in range(n)]
    copies = [(0, [w if k % 8 else "changed" for k, w in enumerate(items[0])]), (1, [*items[1][:-1], "changed"])]
    for _ in range(120):
        i = rng.randrange(6)
        copy = list(items[i])
        for _ in range(rng.randint(0, max(0, (len(copy) - 4) // 4))):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([["changed"], [], [copy[k], "put", "in"][: rng.choice([2, 3])]]) if copy else []
        copies.append((i, copy))
    docs = [(d, noise(rng.randrange(90)) + copy + noise(rng.randrange(90))) for d, (_, copy) in enumerate(copies)] + [(900, ["again"] * 60 + ["and", "again", "and", "again"] * 20), (901, noise(50))]
    expected = {}
    for d, doc in docs:
        for i, item in items.items():
            w = min(4, len(item))
            grams = {tuple(item[k : k + w]) for k in range(len(item) - w + 1)}
            if any(tuple(doc[k : k + w]) in grams for k in range(len(doc) - w + 1)):
                expected[d, i] = smith_waterman(item, doc)
    assert {(d, i) for d, (i, _) in enumerate(copies)} <= set(expected)
    found = eval_leaks.leaks(spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, text string"), edited=True)
    rows = found.collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in rows} == expected
    assert all(r["score_permille"] == r["score"] * 1000 // (2 * len(items[r["item_id"]])) for r in rows)
    # the score alone accepts: nothing without an alignment worth twelve words, no exact run is lost by it
    kept = {(r["doc_id"], r["item_id"]) for r in eval_leaks.accepted(found).collect()}
    assert kept == {k for k, v in expected.items() if v >= 2 * min(12, len(items[k[1]]))}
    assert {tuple(r) for r in eval_leaks.leaked(found).collect()} <= kept


def test_few_changed_words_keep_an_item_found(spark):
    """All copies with up to 2 n / 15 changed words come out; texts that share only loose words don't."""
    rng = random.Random(15)
    items = {i: [f"w{i}x{k}" for k in range(rng.randint(15, 60))] for i in range(30)}
    docs, copies = [], set()
    for d in range(200):
        i = rng.randrange(30)
        copy = list(items[i])
        for k in rng.sample(range(len(copy)), rng.randint(0, 2 * len(copy) // 15)):
            copy[k] = f"changed{d}"
        if d % 4 == 0:
            rng.shuffle(copy)  # no copy
        else:
            copies.add((d, i))
        docs.append((d, " ".join(["before"] * rng.randrange(20) + copy + ["after"] * rng.randrange(20))))
    found = eval_leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, text string"), edited=True)
    assert {(r["doc_id"], r["item_id"]) for r in eval_leaks.edited_copies(found).collect()} == copies


def test_alignment_scores():
    rng = random.Random(11)
    for _ in range(100):
        a, b = (np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 12))]) for _ in range(2))
        h, run, best, longest = np.zeros((len(a) + 1, len(b) + 1)), np.zeros((len(a) + 1, len(b) + 1)), 0, 0
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            same = a[i - 1] == b[j - 1]
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            run[i, j] = run[i - 1, j - 1] + 1 if same else 0
            best, longest = max(best, h[i, j]), max(longest, run[i, j])
        assert eval_leaks.align(a, b) == (best, longest)


# 9: shared spans


@pytest.mark.parametrize("min_chars,wide", [(40, 64), (40, 2), (300, 3), (60, 1)])
def test_shared_spans(spark, min_chars, wide):
    rng = random.Random(12)
    letters = "abcdefgh é語😀 "
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = [noise(rng.randint(min_chars - 3, min_chars * 2)) for _ in range(6)]
    header = noise(min_chars - 5)
    texts = [noise(rng.randint(0, 50)) + rng.choice(parts) + noise(rng.randint(0, 50)) for _ in range(40)]
    texts += [header + noise(60) for _ in range(12)] + [None, "", "short", "ab" * min_chars, "ba" * min_chars + "x", texts[0], texts[0], parts[0]]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, same string, id int")
    spans = shared_spans.shared_spans(df, min_chars=min_chars, wide=wide)
    got = {tuple(r) for r in shared_spans.sharing_pairs(spans, shared_spans.members_of(df, min_chars=min_chars)).collect()}
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for k in range(len(t or "") - min_chars + 1):
            holders[t[k : k + min_chars]].add(i)
    assert got == {(a, b) for h in holders.values() for a in h for b in h if a < b}
    shared = {r["doc_id"]: r["shared_chars"] for r in shared_spans.shared_part(spans, df, min_chars=min_chars).collect()}
    for i, t in enumerate(texts):
        covered = set()
        for k in range(len(t or "") - min_chars + 1):
            if len(holders[t[k : k + min_chars]]) > 1:
                covered.update(range(k, k + min_chars))
        assert shared[i] == len(covered)


def test_shared_spans_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shared_spans.shared_spans(df).spans.count() == 0
    assert spark.range(0).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).count() == 0


def test_texts_with_a_common_head_are_not_sent_for_each_pair(spark):
    """Many different texts with one long head: all 3,160 pairs come out, few by comparing texts (what some share beyond the head); every text's part is its head."""
    rng = random.Random(17)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    head = letters(500)
    rows = [(i, head + letters(rng.randint(100, 400))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    shared = shared_spans.shared_spans(df, wide=8)
    assert shared.spans.count() < 80
    assert {tuple(r) for r in shared_spans.sharing_pairs(shared, shared_spans.members_of(df)).collect()} == {(a, b) for a in range(80) for b in range(a + 1, 80)}
    for r in shared_spans.shared_part(shared, df).collect():
        t = rows[r["doc_id"]][1]
        longest = max(next((k for k, (x, y) in enumerate(zip(t, o)) if x != y), min(len(t), len(o))) for i, o in rows if i != r["doc_id"])
        assert r["shared_chars"] == longest >= 500


@pytest.mark.parametrize("period", sorted(shared_spans.COVERS))
def test_covers(period):
    d = shared_spans.COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


@pytest.mark.parametrize("max_n", [1, 3])
def test_long_records_count_alike(spark, max_n):
    rng = random.Random(5)
    rows = [(r, o, rng.choice(["a", "b", "c", None])) for r, n in ((1, 40), (2, 3), (3, 11), (4, 1)) for o in rng.sample(range(100), n)]
    df = spark.createDataFrame([*rows, *rows[:20], (None, 1, "a"), (5, None, "b")], "r bigint, o int, v string")
    whole, split, all_long = ({tuple(x) for x in term_counts.count_values(df, "r", "o", "v", max_n, k).select("term", "n", "occurrences", "records").collect()} for k in (1000, 10, 0))
    assert whole == split == all_long and len(whole) >= 3


def test_head_just_too_short_makes_no_pairs(spark):
    """A head of one character less than a span in all texts: no candidates; with one character more in some, just those."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    head = letters(299)
    rows = [(i, head + chr(0x100 + i) + letters(200)) for i in range(12)] + [(50 + i, head + "zz" + letters(200)) for i in range(3)]
    used = shared_spans._used(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 300)
    matched = shared_spans.match_anchors(shared_spans.anchor_index(used, 300, 2, 3), 2, 3)
    hot = matched.filter("key IS NOT NULL")
    assert not hot.isEmpty()
    pairs, found, places = shared_spans.refine(hot, used, 300, 3)
    ids = {(r["same"], r["check"]): r["id"] for r in used.collect()}
    assert {tuple(sorted((r["id_a"], r["id_b"]))) for r in pairs.collect()} <= {(50, 51), (50, 52), (51, 52)}
    assert {tuple(sorted((ids[r["same_a"], r["check_a"]], ids[r["same_b"], r["check_b"]]))) for r in found.collect()} == {(50, 51), (50, 52), (51, 52)}
    assert {(ids[r["same"], r["check"]], r["lo"]) for r in places.collect()} == {(i, k) for i in (50, 51, 52) for k in (0, 1)}
