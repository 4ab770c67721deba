"""The same or nearly the same record in training and in evaluation splits.

Method: edit-distance segment join. Overlaps are wanted by the share of distinct runs of three words, wherever the runs
stand, so a record's string is not its text but its canonical string: its distinct runs in one order for all records, the
rarest first. Between two canonical strings the edit distance (runs left out or put in) is the number of runs that only one
of them has; a share of at least ``MIN_PERMILLE`` is thus exactly an edit distance of at most
k = (1000 - share) / (1000 + share) of both lengths. A string is cut after each of its first symbols: with at most 30 % of its
runs edited away, one of the first k + 1 segments stands unchanged in the partner. Segments of evaluation strings
are matched with those of training strings at allowed positions only: lengths must lie within k, the places of a shared
segment must lie within k of each other and leave enough symbols behind them. Pairs are verified by banded dynamic
programming over the canonical strings, which alone decides. (Segments cut from the texts themselves would lose pairs with
moved blocks, whose word edit distance is large.) ``aligned`` also gives the word edit distance of the texts.

The order is by a count of every run in the corpus, added up in ``COUNTERS`` hashed counters: a table of fixed size,
whatever the corpus. Texts that are equal word for word are one class; only classes are joined, members are
added at the end. A segment never matches itself into pairs of one split: the join is evaluation against training. A
segment that more than ``WIDE`` texts of one batch chose is joined as rows, evaluation against training, which
Spark splits where a key is skewed; only a mark of it stays in the packed bucket. Equal texts are told by two independent
64-bit hashes.

Defined results: null and empty texts and texts of fewer than three words have no segment and no pair; a null or other
split takes no part; letter case (ASCII) and everything between words is ignored; repeated rows pair each; ids that
occur in both splits don't pair with themselves; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.words import FOLDED, WordHashes, gram_hashes, words_of
from lodestrata.session import materialize, parallelism, ship_package, spread

SEGMENT = 3
MIN_PERMILLE = 700
#: Fixed number of hashed counters behind the order of segments (512 KB as sent to tasks).
COUNTERS = 1 << 17
HELD_OUT = ("val", "test")
#: Hashed before a text, so that the second hash starts from another state.
CHECK_SEED = 7


def least_shared(n: int, min_permille: int = MIN_PERMILLE) -> int:
    """Fewest shared segments of a text of ``n`` distinct segments with any partner."""
    return max(1, -(-n * min_permille // 1000))


def segments_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    return np.unique(gram_hashes(hashes(words_of(text, FOLDED)), SEGMENT))


def canonical(seg: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct segments in the order that all texts share: by their counters, then by hash."""
    return seg[np.lexsort((seg, counts[_counter(seg).astype(np.int64)]))]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(COUNTERS)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _used(df: DataFrame, id_col: str, text_col: str, split_col: str) -> DataFrame:
    """(id, held_out, same, check, text) of the rows of a split; equal texts share the hashes ``same`` and ``check``."""
    used = df.filter(F.col(split_col).isin("train", *HELD_OUT) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return used.select(F.col(id_col).cast("bigint").alias("id"), (F.col(split_col) != "train").alias("held_out"), F.xxhash64(text_col).alias("same"), F.xxhash64(F.lit(CHECK_SEED), text_col).alias("check"), F.col(text_col).alias("text"))


CHUNKS = 64
#: Texts of a batch that may choose the same segment before it leaves the packed buckets.
WIDE = 256
#: Stands as a text's class in the entry of such a segment.
MARK = -(1 << 63)


def segment_counts(used: DataFrame) -> np.ndarray:
    """Number of texts with a segment of each counter; added up in ``CHUNKS`` groups, of fixed size whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            seg = [segments_of(t, hashes) for t in batch.column(0).to_pylist()]
            if seg:
                total += np.bincount(_counter(np.concatenate(seg)).astype(np.int64), minlength=COUNTERS)
        parts = [x.tobytes() for x in np.split(total, CHUNKS)]
        yield _batch({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": pa.array(parts, pa.binary())})

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = spread(used.select("text")).mapInArrow(run, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(COUNTERS, np.int64)
    for r in parts:
        out.reshape(CHUNKS, -1)[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out


_TEXT = np.dtype([("same", "<i8"), ("check", "<i8"), ("id", "<i8"), ("n", "<i4"), ("held", "u1")])
_ENTRY = np.dtype([("seg", "<u8"), ("text", "<u4"), ("place", "<u4")])
#: Index bytes of one bucket, which one task holds at a time.
BUCKET_BYTES = 16 << 20


def segment_index(used: DataFrame, sent, buckets: int, wide: int = WIDE) -> DataFrame:
    """(bucket, texts, entries): each text's k + 1 rarest segments with their places, packed for each batch and bucket.

    ``sent``: the broadcast counters. Entries of segments that are wide within a batch stand, packed alike, in rows whose
    bucket is ``-1 - bucket``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts, entries = np.zeros(batch.num_rows + 1, _TEXT), []
            texts["same"], texts["check"], texts["id"] = (np.append(batch.column(k).to_numpy(), MARK) for k in (2, 3, 0))
            texts["held"] = np.append(batch.column(1).to_numpy(zero_copy_only=False), False)
            seen = set()
            for k, text in enumerate(batch.column(4).to_pylist()):
                first = (text, texts["held"][k])
                if first in seen:  # an exact copy in the same batch; members are added at the end
                    continue
                seg = segments_of(text, hashes)
                if not len(seg):
                    continue
                seen.add(first)
                texts["n"][k] = len(seg)
                chosen = canonical(seg, sent.value)[: len(seg) - least_shared(len(seg)) + 1]
                own = np.zeros(len(chosen), _ENTRY)
                own["seg"], own["text"], own["place"] = chosen, k, np.arange(len(chosen))
                entries.append(own)
            if not entries:
                continue
            entries = np.concatenate(entries)
            bucket = (entries["seg"] % np.uint64(buckets)).astype(np.int64)
            _, first, inverse, size = np.unique(entries["seg"], return_index=True, return_inverse=True, return_counts=True)
            if (size > wide).any():
                marks, mark_bucket = entries[first[size > wide]], bucket[first[size > wide]]
                marks["text"] = batch.num_rows
                bucket = np.concatenate([np.where(size[inverse] > wide, -1 - bucket, bucket), mark_bucket])
                entries = np.concatenate([entries, marks])
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            out_texts, out_entries = [], []
            for part in np.split(entries, cuts):
                who, part["text"] = np.unique(part["text"], return_inverse=True)
                out_texts.append(texts[who].tobytes())
                out_entries.append(part.tobytes())
            yield _batch({"bucket": pa.array(bucket[np.concatenate([[0], cuts]).astype(np.int64)], pa.int32()), "texts": pa.array(out_texts, pa.binary()), "entries": pa.array(out_entries, pa.binary())})

    return spread(used).mapInArrow(run, "bucket int, texts binary, entries binary")


#: Pairs looked at in one step of a bucket.
STEP_PAIRS = 2_000_000


_ROW = ("seg", "id", "same", "check", "n", "place", "held")


def match_bucket(texts: np.ndarray, seg: np.ndarray, place: np.ndarray, min_permille: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (held out, train) of entries of the same segment whose sizes and places allow the overlap; rows of marked segments."""
    order = np.lexsort((texts["id"], texts["check"], texts["same"], texts["held"], seg))
    texts, seg, place = texts[order], seg[order], place[order]
    # equal texts of one side and segment: the smallest id stands for all
    new = np.ones(len(seg), bool)
    new[1:] = seg[1:] != seg[:-1]
    for k in ("held", "same", "check"):
        new[1:] |= texts[k][1:] != texts[k][:-1]
    texts, seg, place = texts[new], seg[new], place[new]
    marked = np.isin(seg, seg[texts["same"] == MARK])
    wide = rows_of(*(x[marked & (texts["same"] != MARK)] for x in (texts, seg, place)))
    texts, seg, place = texts[~marked], seg[~marked], place[~marked]
    held = np.flatnonzero(texts["held"] == 1)
    train = np.flatnonzero(texts["held"] == 0)
    lo, hi = np.searchsorted(seg[train], seg[held], "left"), np.searchsorted(seg[train], seg[held], "right")
    held, lo, hi = held[hi > lo], lo[hi > lo], hi[hi > lo]
    out, start = [], 0
    reach = np.cumsum(hi - lo)
    while start < len(held):
        end = max(start + 1, int(np.searchsorted(reach, (reach[start - 1] if start else 0) + STEP_PAIRS)))
        n = (hi - lo)[start:end]
        a = np.repeat(held[start:end], n)
        b = train[np.repeat(lo[start:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        na, nb = texts["n"][a].astype(np.int64), texts["n"][b].astype(np.int64)
        need = -(-min_permille * (na + nb) // (1000 + min_permille))
        ok = (np.minimum(na - place[a], nb - place[b]) >= need) & (np.abs(place[a] - place[b]) <= na + nb - 2 * need)
        pairs = np.stack([texts["id"][a[ok]], texts["id"][b[ok]]], axis=1)
        out.append(np.unique(pairs, axis=0))
        start = end
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64), wide


def rows_of(texts: np.ndarray, seg: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Entries as rows of ``_ROW``."""
    return np.stack([seg.view(np.int64), texts["id"], texts["same"], texts["check"], texts["n"].astype(np.int64), place, texts["held"].astype(np.int64)], axis=1)


def candidates(index: DataFrame, buckets: int, min_permille: int = MIN_PERMILLE) -> DataFrame:
    """(id_a, id_b): evaluation and training text that share a segment at allowed positions."""

    def unpacked(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entries = [np.frombuffer(e, _ENTRY) for _, e in rows]
        texts = [np.frombuffer(t, _TEXT)[e["text"]] for (t, _), e in zip(rows, entries, strict=True)]
        entries = np.concatenate(entries)
        return np.concatenate(texts), np.ascontiguousarray(entries["seg"]), entries["place"].astype(np.int64)

    def table_of(pairs: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        empty = np.arange(len(pairs) + len(wide)) < len(pairs)
        columns = {k: pa.array(np.concatenate([pairs[:, i], np.zeros(len(wide), np.int64)]), pa.int64()) for i, k in enumerate(_PAIR)}
        return _batch(columns | {k: pa.array(np.concatenate([np.zeros(len(pairs), np.int64), wide[:, i]]), pa.int64(), mask=empty) for i, k in enumerate(_ROW)})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = defaultdict(list)
        for batch in batches:
            for bucket, t, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows[bucket].append((t, e))
        for bucket in list(rows):
            own = rows.pop(bucket)
            if bucket >= 0:
                yield table_of(*match_bucket(*unpacked(own), min_permille))
                continue
            for row in own:
                yield table_of(np.zeros((0, 2), np.int64), rows_of(*unpacked([row])))

    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.hash("texts", "entries"), F.lit(buckets)))
    schema = ", ".join(f"{k} bigint" for k in (*_PAIR, *_ROW))
    matched = materialize(index.repartitionById(buckets, place).mapInArrow(match, schema).distinct(), "matched")
    pairs, wide = matched.filter("seg IS NULL").select(*_PAIR), matched.filter("seg IS NOT NULL")
    if not wide.isEmpty():
        one = wide.groupBy("seg", "same", "check", "held").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("place").alias("place"))
        side = lambda held, x: one.filter(F.col("held") == held).select("seg", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "place")])
        need = F.ceil((F.col("n_a") + F.col("n_b")) * min_permille / (1000 + min_permille))
        both = side(1, "a").join(side(0, "b"), "seg").filter(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need)
        both = both.filter(F.abs(F.col("place_a") - F.col("place_b")) <= F.col("n_a") + F.col("n_b") - 2 * need)
        pairs = materialize(pairs.unionByName(both.select(*_PAIR)).distinct(), "candidates")
    return pairs


_PAIR = ("id_a", "id_b")


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Word edit distance, or None if it is more than ``band``: only cells within the band around the diagonal are filled."""
    if abs(len(a) - len(b)) > band:
        return None
    # what both begin or end with costs nothing
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    band = min(band, max(n, m))
    far = n + m + 2
    offsets = np.arange(-band, band + 1)  # column less row
    row = np.where((offsets >= 0) & (offsets <= m), offsets, far)
    for i in range(1, n + 1):
        col = i + offsets
        inside = (col >= 0) & (col <= m)
        differs = np.ones(len(col), np.int64)
        real = inside & (col >= 1)
        differs[real] = b[col[real] - 1] != a[i - 1]
        new = row + differs  # from the cell up and left
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # from above
        new[col == 0] = i
        new[~inside] = far
        # from the left: the best cell before, plus one for each step
        row = np.minimum.accumulate(new - offsets) + offsets
        row[~inside] = far
    d = int(row[m - n + band])
    return d if d <= band else None


def banded_indels(a: list[int], b: list[int], band: int) -> int | None:
    """Symbols left out or put in between two strings, or None if more than ``band``: dynamic programming over the cells within the band.

    A row of the table, one for each symbol of ``b``, is a bit vector: a zero where the longest common part grows from one
    cell to the next. Rows whose symbol ``a`` doesn't have leave it as it is.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    at: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    lo, hi, row, common = 0, 0, 0, 0  # the row's cells and those before them that are done with
    for j, y in enumerate(b):
        places = at.get(y)
        if places is None:
            continue
        start, end = min(n, max(0, j - band)), min(n, j + band + 1)
        row |= ((1 << (end - hi)) - 1) << (hi - lo)
        gone = row & ((1 << (start - lo)) - 1)
        common += start - lo - gone.bit_count()
        row >>= start - lo
        lo, hi = start, end
        hits = 0
        for i in places:
            if lo <= i < hi:
                hits |= 1 << (i - lo)
        hits &= row
        row = ((row + hits) | (row - hits)) & ((1 << (hi - lo)) - 1)
    d = n + m - 2 * (common + hi - lo - row.bit_count())
    return d if d <= band else None


def overlaps(df: DataFrame, id_col: str = "fn_id", text_col: str = "func", split_col: str = "split", min_permille: int = MIN_PERMILLE, wide: int = WIDE, aligned: bool = False) -> DataFrame:
    """(id_a, same_a, check_a, id_b, same_b, check_b, shared, total, edits): one row for each pair of different texts, or of one text on both sides.

    ``id_a`` is held out, ``id_b`` in training, each one with that text in its side. ``shared`` of ``total`` distinct runs are
    in both. ``edits`` is, if ``aligned``, the word edit distance, and null where blocks were moved beyond the band.
    """
    spark = df.sparkSession
    ship_package(spark)
    used = _used(df, id_col, text_col, split_col)
    counts = segment_counts(used)
    sent = spark.sparkContext.broadcast(counts)
    about = int(counts.sum()) * (1000 - min_permille) // 1000 * (_ENTRY.itemsize + _TEXT.itemsize)
    buckets = max(parallelism(spark), about // BUCKET_BYTES)
    pairs = candidates(segment_index(used, sent, buckets, wide), buckets, min_permille)
    needed = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).distinct()
    texts = used.join(needed, "id", "left_semi")
    side = lambda held, x: texts.filter(F.col("held_out") == held).select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "same", "check", "text")])
    both = pairs.join(side(True, "a"), "id_a").join(side(False, "b"), "id_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def read(text: str) -> tuple[np.ndarray, list[int]]:
            words = hashes(words_of(text, FOLDED))
            return words, canonical(np.unique(gram_hashes(words, SEGMENT)), sent.value).tolist()

        for batch in batches:
            rows, known = [], {}  # a text of the batch is read once, whatever its pairs
            for *ids, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for text in (ta, tb):
                    if text not in known:
                        known[text] = read(text)
                (ha, a), (hb, b) = known[ta], known[tb]
                d = banded_indels(a, b, (len(a) + len(b)) * (1000 - min_permille) // (1000 + min_permille))
                if d is not None:
                    edits = banded_distance(ha, hb, d + abs(len(ha) - len(hb))) if aligned else None
                    rows.append((*ids, (len(a) + len(b) - d) // 2, (len(a) + len(b) + d) // 2, edits))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield _batch({k: pa.array(c, pa.int64()) for k, c in zip(names, columns, strict=True)})

    names = (*_SIDES, "shared", "total", "edits")
    return both.select(*_SIDES, "text_a", "text_b").mapInArrow(verify, ", ".join(f"{k} bigint" for k in names))


_SIDES = ("id_a", "same_a", "check_a", "id_b", "same_b", "check_b")


def all_pairs(found: DataFrame, df: DataFrame, id_col: str = "fn_id", text_col: str = "func", split_col: str = "split") -> DataFrame:
    """(fn_id_a, fn_id_b), the smaller id first: the found pairs with every member of their texts."""
    members = _used(df, id_col, text_col, split_col).drop("text")
    held, train = (members.filter(F.col("held_out") == h).select(F.col("same").alias(f"same_{x}"), F.col("check").alias(f"check_{x}"), F.col("id").alias(i)) for h, x, i in ((True, "a", "x"), (False, "b", "y")))
    pairs = found.select("same_a", "check_a", "same_b", "check_b").join(held, ["same_a", "check_a"]).join(train, ["same_b", "check_b"]).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("fn_id_a"), F.greatest("x", "y").alias("fn_id_b")).distinct()
