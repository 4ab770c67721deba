"""Long spans that stand verbatim in more than one text.

Method: difference-cover anchors. With a period v and a cover D (every difference modulo v is one of two members of
D), windows of w = min_chars - v + 1 characters are hashed only at places whose remainder modulo v is in D. Of any two
equal spans of ``min_chars``, wherever they start, some window within both starts at a cover place in both texts; so
texts that share no anchor share no such span. Texts that share one are compared by extension along the diagonals of
their shared anchors, which gives every maximal common span.

Anchors are packed for each batch and bucket of the hash (6 bytes each), so that one shuffle carries them. Equal texts are
one class throughout, told by two independent 64-bit hashes: the class takes part once, its members are added at the end. An anchor held by more than ``WIDE``
classes (boilerplate shorter than a span) emits no pairs: its texts are regrouped by windows extended around that
anchor to nearly ``min_chars`` characters, one grouping for each way to lay out the rest to its left and right, and
groupings with the same members are joined once. A grouping that is wide even so is laid out again, to whole spans of
``min_chars`` characters, told by two independent 64-bit hashes: what shares one is in the result without any text being sent
for its pairs, and covers that place of its text. So a text that hundreds of others share a head with travels once, not
once for each of them. An
anchor that is wide within one batch of a task goes that way at once and leaves only a mark in its bucket, so that no
bucket gathers the texts of a hot anchor.

Defined results: null, empty and shorter texts share nothing; equal texts of at least ``min_chars`` share all of
their text; characters are Unicode code points, compared exactly; a text's repetition of itself doesn't count; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.words import BASE, mix
from lodestrata.session import materialize, parallelism, ship_package, spread

MIN_CHARS = 300
#: Perfect difference sets by their period; fixed values.
COVERS = {
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    31: [0, 1, 3, 8, 12, 18],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
    133: [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109],
    183: [0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175],
}
#: Classes of texts of one anchor beyond which it is refined before pairs are made.
WIDE = 64
#: Ways to lay out the rest of a span around a refined anchor.
LAYOUTS = 14
BUCKET_BYTES = 16 << 20
#: Hashed before a text, so that the second hash starts from another state.
CHECK_SEED = 9
#: Of the second hash of whole spans; fixed values.
PRIME, CHECK_BASES = (1 << 31) - 1, (1_103_515_245, 1_664_525_077)
#: Characters hashed at a time within a task.
BLOCK_CHARS = 1_000_000


class Cover:
    """Window and cover places for a least span length."""

    def __init__(self, min_chars: int):
        fitting = [v for v in COVERS if v * 5 <= min_chars * 3 + 20]
        if not fitting:
            raise ValueError(f"spans of at least 10 characters; not {min_chars}")
        self.min_chars, self.v = min_chars, max(fitting)
        self.w = min_chars - self.v + 1
        self.d = np.array(COVERS[self.v], np.int64)
        self._places, self._power, self._inverse = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def places(self, n: int) -> np.ndarray:
        """Cover places of a text of ``n`` characters."""
        if n < self.min_chars:
            return self._places[:0]
        if not len(self._places) or self._places[-1] < n:
            rounds = n // self.v + 2
            self._places = (np.arange(rounds * 2)[:, None] * self.v + self.d).ravel()
        return self._places[: np.searchsorted(self._places, n - self.w, "right")]

    def sums(self, code: np.ndarray) -> np.ndarray:
        """Prefix sums from which ``hashes`` gets the hash of any window."""
        n = len(code)
        if len(self._power) < n + 1:
            self._power, self._inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self._power[:n])])

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self._inverse[start])

    def checks(self, code: np.ndarray, start: np.ndarray) -> np.ndarray:
        """A second hash of the spans of ``min_chars`` characters at ``start``: polynomials modulo a prime with two bases, 62 bits."""
        out, step = np.zeros(len(start), np.uint64), 4096  # spans at a time
        for base in CHECK_BASES:
            weights = np.array([pow(base, self.min_chars - 1 - k, PRIME) for k in range(self.min_chars)], np.uint64)
            for i in range(0, len(start), step):
                rows = np.lib.stride_tricks.sliding_window_view(code, self.min_chars)[start[i : i + step]] + np.uint64(1)
                value = (rows * weights % np.uint64(PRIME)).sum(axis=1) % np.uint64(PRIME)
                out[i : i + step] = (out[i : i + step] << np.uint64(31)) | value
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors_of(texts: list[str], cover: Cover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place) of every anchor of the texts."""
    starts, numbers, places, base = [], [], [], 0
    for k, t in enumerate(texts):
        p = cover.places(len(t))
        if len(p):
            starts.append(p + base)
            places.append(p)
            numbers.append(np.full(len(p), k, np.int64))
        base += len(t)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    sums = cover.sums(code_points("".join(texts)))
    return cover.hashes(sums, start, start + cover.w), np.concatenate(numbers), np.concatenate(places)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_TEXT = np.dtype([("same", "<i8"), ("check", "<i8"), ("id", "<i8"), ("n", "<u4")])
#: Stands as a text's class and id in the entry of an anchor that is wide within a batch.
MARK = -(1 << 63)


def _used(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    used = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars))
    return used.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("same"), F.xxhash64(F.lit(CHECK_SEED), text_col).alias("check"), F.col(text_col).alias("text"))


def anchor_index(used: DataFrame, min_chars: int, buckets: int, wide: int) -> DataFrame:
    """(bucket, texts, hashes): anchors packed for each batch and bucket, 6 bytes of hash each, in the order of ``texts``.

    Anchors held by more than ``wide`` texts of a batch are left out but for one entry of the text ``MARK``; they stand, packed
    alike, in rows whose bucket is ``-1 - bucket``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover, seen = Cover(min_chars), set()
        for batch in batches:
            ids, same, check = (np.append(batch.column(k).to_numpy(), MARK) for k in range(3))
            seen.clear()
            hashes, owners, block, chars, first = [], [], [], 0, 0
            texts = batch.column(3).to_pylist()
            for k, text in enumerate(texts):
                if text in seen:  # a copy within the batch; its id is added with the members
                    text = ""
                seen.add(text)
                block.append(text)
                chars += len(text)
                if chars >= BLOCK_CHARS or k == len(texts) - 1:
                    h, owner, _ = anchors_of(block, cover)
                    hashes.append(h)
                    owners.append(owner + first)
                    block, chars, first = [], 0, k + 1
            if not hashes:
                continue
            h, owner = np.concatenate(hashes), np.concatenate(owners)
            if not len(h):
                continue
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((h, owner, bucket)) if buckets > 1 else np.lexsort((h, owner))
            h, owner, bucket = h[order], owner[order], bucket[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner, bucket = h[once], owner[once], bucket[once]
            _, inverse, size = np.unique(h, return_inverse=True, return_counts=True)
            hot = size[inverse] > wide
            if hot.any():
                marked, at = np.unique(h[hot], return_index=True)
                marks = bucket[hot][at]
                bucket = np.concatenate([np.where(hot, -1 - bucket, bucket), marks])
                h, owner = np.concatenate([h, marked]), np.concatenate([owner, np.full(len(marked), len(texts))])
                order = np.lexsort((h, owner, bucket))
                h, owner, bucket = h[order], owner[order], bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(h)]])
            out_texts, out_hashes = [], []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                who, n = np.unique(owner[i:j], return_counts=True)
                t = np.zeros(len(who), _TEXT)
                t["same"], t["check"], t["id"], t["n"] = same[who], check[who], ids[who], n
                out_texts.append(t.tobytes())
                out_hashes.append(np.ascontiguousarray(h[i:j].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
            yield _batch({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "texts": pa.array(out_texts, pa.binary()), "hashes": pa.array(out_hashes, pa.binary())})

    return spread(used).mapInArrow(run, "bucket int, texts binary, hashes binary")


_PAIRS = ("id_a", "id_b")


def group_anchors(texts: np.ndarray, key: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes that share a key held by at most ``wide`` classes; members (id, key) of wider or marked keys."""
    order = np.lexsort((texts["id"], texts["check"], texts["same"], key))
    key, texts = key[order], texts[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (texts["same"][1:] != texts["same"][:-1]) | (texts["check"][1:] != texts["check"][:-1])
    key, texts = key[once], texts[once]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(key)]]))
    # a mark comes first among its key's classes
    group = np.repeat(np.where((texts["same"] == MARK)[first], wide + 1, size), size) if len(key) else size
    small = np.flatnonzero((group > 1) & (group <= wide))
    key_s, id_s = key[small], texts["id"][small]
    out = []
    for step in range(1, wide):
        at = np.flatnonzero(key_s[step:] == key_s[:-step])
        if not len(at):
            break
        # classes stand in the order of ``same`` and ``check``
        out.append(np.unique(np.stack([id_s[at], id_s[at + step]], axis=1), axis=0))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    hot = np.flatnonzero((group > wide) & (texts["same"] != MARK))
    return pairs, np.stack([texts["id"][hot], key[hot].astype(np.int64)], axis=1)


def match_anchors(index: DataFrame, buckets: int, wide: int) -> DataFrame:
    """(id_a, id_b, key): pairs, with null key; or a class of a wide anchor as a, with the anchor's key."""

    def unpacked(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        texts, keys = [], []
        for t, h in rows:
            t = np.frombuffer(t, _TEXT)
            texts.append(np.repeat(t, t["n"]))
            eight = np.zeros((len(h) // 6, 8), np.uint8)
            eight[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
            keys.append(eight.reshape(-1).view(np.uint64))
        return np.concatenate(texts), np.concatenate(keys)

    def table_of(pairs: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        both = np.concatenate([pairs, np.stack([hot[:, 0], np.zeros(len(hot), np.int64)], axis=1)])
        key = np.concatenate([np.zeros(len(pairs), np.int64), hot[:, 1]])
        return _batch({c: pa.array(both[:, k], pa.int64()) for k, c in enumerate(_PAIRS)} | {"key": pa.array(key, pa.int64(), mask=np.arange(len(both)) < len(pairs))})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = defaultdict(list)
        for batch in batches:
            for bucket, t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows[bucket].append((t, h))
        for bucket in list(rows):
            own = rows.pop(bucket)
            if bucket >= 0:
                yield table_of(*group_anchors(*unpacked(own), wide))
                continue
            for row in own:  # wide within a batch
                texts, key = unpacked([row])
                yield table_of(np.zeros((0, 2), np.int64), np.stack([texts["id"], key.astype(np.int64)], axis=1))

    # a partition for each bucket; rows of wide anchors go anywhere
    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.hash("texts", "hashes"), F.lit(buckets)))
    return index.repartitionById(buckets, place).mapInArrow(match, "id_a bigint, id_b bigint, key bigint").distinct()


def _members(windows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of (id, same, check, key, key2): the classes of each key, and each key's number and digests of classes where there are several."""
    members = materialize(windows.groupBy("key", "key2", "same", "check").agg(F.min("id").alias("id")), name)
    digest = [F.sum(F.xxhash64(F.lit(k), "same", "check").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    return members, materialize(members.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n"), *digest).filter("n > 1"), f"{name}-kinds")


def _pairs_within(members: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id_a, same_a, check_a, id_b, same_b, check_b): pairs of classes of a key; of keys with the same members, which give the same pairs, one stays."""
    m = members.join(kinds.groupBy("n", "s1", "s2").agg(F.min(F.struct("key", "key2")).alias("k")).select("k.*"), ["key", "key2"])
    a, b = (m.select("key", "key2", F.struct("same", "check").alias(f"class_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "same", "check")]) for x in "ab")
    return a.join(b, ["key", "key2"]).filter("class_a < class_b").select(*[f"{c}_{x}" for x in "ab" for c in ("id", "same", "check")]).distinct()


class Refined(NamedTuple):
    """What becomes of wide anchors: ``pairs`` (id_a, id_b) still to be compared; of the others, ``found`` pairs of classes (same_a, check_a, same_b, check_b)
    and the places (same, check, lo) of their spans of ``min_chars`` characters that stand in several classes. The last two are null where there are none."""

    pairs: DataFrame
    found: DataFrame | None
    places: DataFrame | None


def refine(hot: DataFrame, used: DataFrame, min_chars: int, wide: int) -> Refined:
    """Pairs of classes that share a window of nearly ``min_chars`` characters around a wide anchor.

    Windows that are wide as well are laid out once more, to all windows of ``min_chars`` characters around them; what shares
    one of those is a pair of the result, so that texts with a common head just too short make no pairs.
    """
    keys = hot.groupBy(F.col("id_a").alias("id")).agg(F.collect_set("key").alias("keys"))  # at most one text's anchors

    def windows(rows: DataFrame, exact: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cover = Cover(min_chars)
            slack = cover.v - 1
            step = -(-(slack + 1) // LAYOUTS)
            for batch in batches:
                for doc, same, check, wanted, within, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    h, _, place = anchors_of([text], cover)
                    at = place[np.isin((h & np.uint64((1 << 48) - 1)).astype(np.int64), np.array(wanted, np.int64))]
                    code = code_points(text)
                    sums, near, starts = cover.sums(code), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                    for i in range(LAYOUTS):
                        left, right = min(i * step, slack), max(0, slack - (i + 1) * step + 1)
                        ok = at[(at >= left) & (at + cover.w + right <= len(text))]
                        key = cover.hashes(sums, ok - left, ok + cover.w + right) + np.uint64(i)
                        if not exact:
                            near.append(key)
                            continue
                        ok, rest = ok[np.isin(key.view(np.int64), np.array(within, np.int64))], slack - left - right
                        first = (ok[:, None] - left - np.arange(rest + 1)).ravel()
                        starts.append(first[(first >= 0) & (first + min_chars <= len(text))])
                    if exact:
                        lo = np.unique(np.concatenate(starts))
                        got, second = cover.hashes(sums, lo, lo + min_chars).view(np.int64), cover.checks(code, lo).view(np.int64) if len(lo) else lo
                    else:
                        got = np.unique(np.concatenate(near)).view(np.int64)
                        lo = second = np.zeros(len(got), np.int64)
                    yield _batch({k: pa.array(np.full(len(got), v), pa.int64()) for k, v in (("id", doc), ("same", same), ("check", check))} | {"key": pa.array(got, pa.int64()), "key2": pa.array(second, pa.int64()), "lo": pa.array(lo, pa.int64())})

        return rows.select("id", "same", "check", "keys", "within", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in ("id", "same", "check", "key", "key2", "lo")))

    members, kinds = _members(windows(keys.withColumn("within", F.lit(None).cast("array<bigint>")).join(used, "id"), False), "refined")
    pairs = _pairs_within(members, kinds.filter(F.col("n") <= wide)).select(*_PAIRS)
    still = kinds.filter(F.col("n") > wide).select("key")
    if still.isEmpty():
        return Refined(pairs, None, None)
    within = members.join(still, "key").groupBy("id").agg(F.collect_set("key").alias("within"))  # likewise
    whole = materialize(windows(keys.join(within, "id").join(used, "id"), True), "whole")
    members, kinds = _members(whole, "exact")
    places = whole.join(kinds.select("key", "key2"), ["key", "key2"]).select("same", "check", "lo").distinct()
    return Refined(pairs, _pairs_within(members, kinds).select(*_CLASSES), places)


def common_spans(a: str, b: str, cover: Cover) -> list[tuple[int, int, int]]:
    """Maximal common spans (start in a, start in b, length) of at least ``min_chars`` characters."""
    ha, _, pa_ = anchors_of([a], cover)
    hb, _, pb = anchors_of([b], cover)
    order = np.argsort(hb, kind="stable")
    hb, pb = hb[order], pb[order]
    lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    n = hi - lo
    shift = np.unique(pb[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] - np.repeat(pa_, n))
    ca, cb, out = code_points(a), code_points(b), []
    for d in shift.tolist():
        start, end = max(0, -d), min(len(ca), len(cb) - d)
        differ = np.flatnonzero(ca[start:end] != cb[start + d : end + d]) + start
        bounds = np.concatenate([[start - 1], differ, [end]])
        for k in np.flatnonzero(np.diff(bounds) > cover.min_chars).tolist():
            at = int(bounds[k]) + 1
            out.append((at, at + d, int(bounds[k + 1]) - at))
    return out


_CLASSES = ("same_a", "check_a", "same_b", "check_b")


class Shared(NamedTuple):
    """``spans``: (same_a, check_a, same_b, check_b, start_a, start_b, chars), every maximal common span of two different texts that were compared.
    ``found`` and ``places`` as in ``Refined``: pairs and places of spans that many texts share, which needed no comparison."""

    spans: DataFrame
    found: DataFrame | None
    places: DataFrame | None


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, wide: int = WIDE) -> Shared:
    """The common spans of different texts (classes of equal texts)."""
    spark = docs.sparkSession
    ship_package(spark)
    used = _used(docs, id_col, text_col, min_chars)
    cover = Cover(min_chars)
    chars = used.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(parallelism(spark), chars * len(cover.d) // cover.v * 8 // BUCKET_BYTES)
    matched = materialize(match_anchors(anchor_index(used, min_chars, buckets, wide), buckets, wide), "anchors")
    pairs, found, places = matched.filter("key IS NULL").select(*_PAIRS), None, None
    hot = matched.filter("key IS NOT NULL")
    if not hot.isEmpty():
        refined, found, places = refine(hot, used, min_chars, wide)
        pairs = materialize(pairs.unionByName(refined).distinct(), "pairs")
    needed = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).distinct()
    texts = used.join(needed, "id", "left_semi")
    for x in "ab":
        pairs = pairs.join(texts.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "same", "check", "text")]), f"id_{x}")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(min_chars)
        for batch in batches:
            rows = []
            for *classes, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend((*classes, *span) for span in common_spans(ta, tb, cover))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield _batch({k: pa.array(c, pa.int64()) for k, c in zip(names, columns, strict=True)})

    names = (*_CLASSES, "start_a", "start_b", "chars")
    return Shared(pairs.select(*_CLASSES, "text_a", "text_b").mapInArrow(extend, ", ".join(f"{k} bigint" for k in names)), found, places)


def members_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    return _used(docs, id_col, text_col, min_chars).drop("text")


def sharing_pairs(shared: Shared, members: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller id first: texts with a common span, and equal texts."""
    of = lambda x: members.select(F.col("same").alias(f"same_{x}"), F.col("check").alias(f"check_{x}"), F.col("id").alias(x))
    classes = shared.spans.select(*_CLASSES)
    if shared.found is not None:
        classes = classes.unionByName(shared.found)
    between = classes.distinct().join(of("a"), ["same_a", "check_a"]).join(of("b"), ["same_b", "check_b"]).select("a", "b")
    one = lambda x: members.select("same", "check", F.col("id").alias(x))
    within = one("a").join(one("b"), ["same", "check"]).filter("a < b").select("a", "b")
    return between.unionByName(within).filter("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def shared_part(shared: Shared, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, chars, shared_chars) of every document: how much of it stands elsewhere in spans of ``min_chars``."""
    side = lambda x: shared.spans.select(F.col(f"same_{x}").alias("same"), F.col(f"check_{x}").alias("check"), F.col(f"start_{x}").alias("lo"), "chars")
    sides = side("a").unionByName(side("b"))
    if shared.places is not None:
        sides = sides.unionByName(shared.places.withColumn("chars", F.lit(min_chars).cast("bigint")))
    sides = sides.groupBy("same", "check", "lo").agg((F.col("lo") + F.max("chars")).alias("hi"))
    before = Window.partitionBy("same", "check").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    covered = sides.withColumn("upto", F.coalesce(F.max("hi").over(before), F.lit(0)))
    covered = covered.groupBy("same", "check").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "upto"))).alias("covered"))
    members = members_of(docs, id_col, text_col, min_chars)
    copies = members.groupBy("same", "check").agg(F.count_distinct("id").alias("copies"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("chars"), F.xxhash64(text_col).alias("same"), F.xxhash64(F.lit(CHECK_SEED), text_col).alias("check"))
    joined = texts.join(covered, ["same", "check"], "left").join(copies, ["same", "check"], "left")
    part = F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return joined.select("doc_id", "chars", F.when(F.col("chars") >= min_chars, part).otherwise(F.lit(0)).cast("bigint").alias("shared_chars"))
