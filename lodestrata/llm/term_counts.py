"""Frequency of every distinct term, and of every n-gram of terms, over a whole collection.

Method: suffix array with common-prefix intervals. A block of records is one sequence of symbols, in which terms follow one
another: a word is its bytes, eight to a symbol, up to a zero byte; a value of a column is one symbol. A task sorts the
suffixes that begin at terms, symbol by symbol, each to the end of its first ``max_n`` terms, and notes at which depth
neighbours part. Suffixes whose common prefix covers n terms form an interval: an n-gram, with as many occurrences as the
interval is long. With an interval's suffixes in the order of their records, the number of records is its length less
the adjacencies of equal record. Blocks then add up: since no record spans two blocks, record counts are exact. Hot terms
leave a block as one row, whatever their number of occurrences.

Records of more than ``LONG_RECORD`` rows of a value column are cut into chunks of so many rows by ranges of their order, so
that no task holds such a record. A chunk is a block as well; its intervals keep the record's id, by which a term counts
once for the record.

Defined results: null or empty texts hold no term but count as records where ``records`` says so; null terms are no
terms; a repeated record counts as a further record unless it has the same id; n-grams of values that hold blanks are
told apart though their joined texts may be alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.words import KEPT
from lodestrata.operators.ranking import RANGES, spread_rank
from lodestrata.session import materialize, ship_package, spread

RARE_BELOW = 3
COMMON_PERMILLE = 400
#: Bytes of text in one suffix array; a longer record has a block of its own. Values in one.
BLOCK_BYTES, BLOCK_VALUES = 4 << 20, 400_000
#: Rows of one record beyond which it isn't gathered in a task.
LONG_RECORD = 400_000


def suffix_array(symbols: np.ndarray, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes at ``start`` in order, each to its ``depth`` symbols, and how many symbols each has in common with the one before.

    Symbols are above zero. Suffixes that are equal to their depth stay in the order given; their common prefix is a large number.
    """
    n, never = len(start), np.iinfo(np.int64).max
    key = symbols[start]
    order = np.argsort(key, kind="stable")
    key = key[order]
    common = np.full(n, never)
    common[1:][key[1:] != key[:-1]] = 0
    common[:1] = 0
    d = 1
    open_ = np.arange(n)  # places of the array whose suffixes may still part
    while True:
        cut = common[open_] != never
        # suffixes alone in their class are done, and so are classes in which none goes on
        kind = np.cumsum(cut) - 1
        size = np.bincount(kind)
        longer = np.bincount(kind, weights=depth[order[open_]] > d) > 0
        open_ = open_[((size > 1) & longer)[kind]]
        if not len(open_):
            return order, common
        own = order[open_]
        key = np.where(depth[own] > d, symbols[np.minimum(start[own] + d, len(symbols) - 1)], np.uint64(0))
        kind = np.cumsum(common[open_] != never)
        by = np.lexsort((key, kind))
        order[open_], key = own[by], key[by]
        parted = np.flatnonzero((kind[1:] == kind[:-1]) & (key[1:] != key[:-1])) + 1
        common[open_[parted]] = d
        d += 1


def suffix_intervals(symbols: np.ndarray, first: np.ndarray, record: np.ndarray, max_n: int, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n up to ``max_n``: (a place of the n-gram, occurrences, records) of every distinct n-gram.

    Term k has the symbols from ``first[k]`` to ``first[k + 1]`` and stands in ``record[k]``, which never decreases. N-grams don't
    cross records. Only those that begin at a place where ``counts`` holds are counted.
    """
    total = len(record)
    place = np.arange(total)
    last = np.searchsorted(record, record, "right")  # end of each term's record
    reach = np.minimum(place + max_n, last)
    begin = place if counts is None else np.flatnonzero(counts)
    order, common = suffix_array(symbols, first[begin], (first[reach] - first[:-1])[begin])
    order = begin[order]
    of_record = record[order]
    for n in range(1, max_n + 1):
        whole = order + n <= last[order]
        new = whole & (common < first[np.minimum(order + n, total)] - first[order])
        interval = (np.cumsum(new) - 1)[whole]
        own, at = of_record[whole], order[new]
        occurrences = np.bincount(interval, minlength=len(at))
        if n < max_n:  # deeper terms come before the record in the array's order
            by_record = np.lexsort((own, interval))
            interval, own = interval[by_record], own[by_record]
        again = (interval[1:] == interval[:-1]) & (own[1:] == own[:-1])
        yield at, occurrences, occurrences - np.bincount(interval[1:][again], minlength=len(at))


_COUNTED = "term string, n int, occurrences bigint, records bigint"


def _rows(terms: pa.Array, n: int, occurrences: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(terms), n, np.int32)), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], names=["term", "n", "occurrences", "records"])


def _slices(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Texts of the byte ranges of ``data``."""
    n = hi - lo
    offsets = np.concatenate([[0], np.cumsum(n)])
    flat = data[np.repeat(lo - offsets[:-1], n) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.string(), len(lo), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def count_text_block(texts: list[bytes], max_n: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of words of a block of texts, in which all but the words' bytes are blanks."""
    if not texts:
        return
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    word = data != 0x20
    # one blank between words, so that an n-gram is one range of bytes
    kept = word.copy()
    kept[1:] |= word[:-1]
    text_end = np.cumsum(np.concatenate([[0], kept]))[np.cumsum([1 + len(t) for t in texts])]
    data, word = data[kept], word[kept]
    lo = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
    if not len(lo):
        return
    hi = np.flatnonzero(~word)
    record = np.searchsorted(text_end, lo, "right")
    n_symbols = (hi - lo) // 8 + 1
    first = np.concatenate([[0], np.cumsum(n_symbols)])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.repeat(lo - first[:-1] * 8, n_symbols) + np.arange(first[-1]) * 8
    end = np.repeat(hi, n_symbols)
    symbols = np.zeros(len(at), np.uint64)
    for k in range(8):
        symbols = (symbols << np.uint64(8)) | np.where(at + k < end, padded[np.minimum(at + k, len(data))], 0).astype(np.uint64)
    symbols += np.uint64(1)  # bytes of words are below 128, so nothing is carried over
    for n, (place, occurrences, records) in enumerate(suffix_intervals(symbols, first, record, max_n), 1):
        yield _rows(_slices(data, lo[place], hi[place + n - 1]), n, occurrences, records)


def count_value_block(parts: list[list], max_n: int, own: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """The n-grams of values of a block, one list of values for each record; of each, n-grams that begin at its first ``own`` values.

    A blank or backslash within a value of an n-gram has a backslash before it.
    """
    numbers: dict[str, int] = {}
    for part in parts:
        for t in set(part).difference(numbers):
            numbers[t] = len(numbers)
    lens = [len(p) for p in parts]
    total = sum(lens)
    if not total:
        return
    symbols = np.fromiter((numbers[t] + 1 for p in parts for t in p), np.uint64, total)
    counts = None if own is None else np.concatenate([np.arange(n) < k for n, k in zip(lens, own, strict=True)])
    names = [t.replace("\\", "\\\\").replace(" ", "\\ ") for t in numbers]
    for n, (place, occurrences, records) in enumerate(suffix_intervals(symbols, np.arange(total + 1), np.repeat(np.arange(len(parts)), lens), max_n, counts), 1):
        terms = [" ".join([names[x - 1] for x in symbols[p : p + n].tolist()]) for p in place.tolist()]
        yield _rows(pa.array(terms, pa.string()), n, occurrences, records)


def _total(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def count_words(df: DataFrame, text_col: str, max_n: int = 1) -> DataFrame:
    """(term, n, occurrences, records) of the words of a text column; every row is a record of its own."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    texts.append(text.encode("utf-8", "surrogatepass").translate(KEPT))
                    size += len(text)
                if size >= BLOCK_BYTES:
                    yield from count_text_block(texts, max_n)
                    texts, size = [], 0
        yield from count_text_block(texts, max_n)

    return _total(spread(df.select(text_col)).mapInArrow(run, _COUNTED))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """(keys, rows of the last columns) of runs of equal first columns; a run may come in several parts."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*columns[:-1], strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                yield keys[start], columns[-1][start:k]
                start = k


def count_long_records(rows: DataFrame, max_n: int, chunk: int) -> DataFrame:
    """The counts of records (r, o, v) of any length, in blocks of ``chunk`` rows and the few after them; ``o`` must be a number or a timestamp."""
    own = rows.groupBy("r", "o").agg(F.min("v").alias("v")).filter(F.col("v").isNotNull())
    place = F.col("o").cast("double")
    lo, hi = own.agg(F.min(place), F.max(place)).first()
    cell = F.coalesce(F.floor((place - F.lit(lo)) / F.lit((hi - lo + 1) if lo is not None else 1.0) * RANGES).cast("int"), F.lit(0))
    own = spread_rank(own, ["r"], ["o"], cell).withColumn("rank", F.col("rank") - 1)
    # the first rows of a chunk stand behind the chunk before as well, where its last n-grams end
    inside = F.col("rank") % chunk
    own = own.withColumn("chunk", F.floor(F.col("rank") / chunk))
    own = own.withColumn("tail", F.explode(F.when((inside < max_n - 1) & (F.col("chunk") > 0), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    own = own.withColumn("chunk", F.col("chunk") - F.col("tail").cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(r, values: list, n_own: int) -> Iterator[pa.RecordBatch]:
            for b in count_value_block([values], max_n, [n_own]):
                yield b.append_column("r", pa.array([r] * len(b), kind))

        last, values, n_own = None, [], 0
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for (r, c, tail), v in _chunks([batch]):
                if last is not None and last != (r, c):
                    yield from counted(last[0], values, n_own)
                    values, n_own = [], 0
                last = (r, c)
                values = values + v
                n_own += 0 if tail else len(v)
        if last is not None:
            yield from counted(last[0], values, n_own)

    key = rows.schema["r"].dataType.simpleString()
    one = own.repartition("r", "chunk").sortWithinPartitions("r", "chunk", "tail", "rank").select("r", "chunk", "tail", "v").mapInArrow(run, f"{_COUNTED}, r {key}")
    return one.groupBy("term", "n", "r").agg(F.sum("occurrences").alias("occurrences")).select("term", "n", "occurrences", F.lit(1).cast("bigint").alias("records"))


def count_values(df: DataFrame, record_col: str, order_col: str, value_col: str, max_n: int = 1, long_record: int = LONG_RECORD) -> DataFrame:
    """(term, n, occurrences, records) of a value column; rows of one ``record_col`` form a record, in the order of ``order_col``.

    Rows of the same record and place are one delivery.
    """
    ship_package(df.sparkSession)
    one = df.filter(F.col(record_col).isNotNull()).select(F.col(record_col).alias("r"), F.col(order_col).alias("o"), F.col(value_col).cast("string").alias("v"))
    long, counted = materialize(one.groupBy("r").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > long_record).select("r"), "long"), None
    if not long.isEmpty():
        counted = count_long_records(one.join(long, "r", "left_semi"), max_n, max(max_n, long_record))
        one = one.join(long, "r", "left_anti")
    one = one.repartition("r").groupBy("r", "o").agg(F.min("v").alias("v")).filter(F.col("v").isNotNull()).sortWithinPartitions("r", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, None
        for batch in batches:
            ids, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
                if i == j:
                    continue
                if parts and last == ids[i]:
                    parts[-1].extend(values[i:j])
                else:
                    if size >= BLOCK_VALUES:
                        yield from count_value_block(parts, max_n)
                        parts, size = [], 0
                    parts.append(values[i:j])
                    last = ids[i]
                size += j - i
        yield from count_value_block(parts, max_n)

    short = one.select("r", "v").mapInArrow(run, _COUNTED)
    total = _total(short if counted is None else short.unionByName(counted))
    return total.withColumn("term", F.regexp_replace("term", r"(?s)\\(.)", "$1"))


def mark(records: Column, total: Column) -> Column:
    """'rare', 'common' or null."""
    return F.when(records < RARE_BELOW, "rare").when(records * 1000 > total * COMMON_PERMILLE, "common")
