"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: inside each task the distinct words are handed to an in-process DuckDB. A recursive query joins the pairs of
neighbouring tokens of each word with the merge table and contracts the leftmost pair of least rank, until no pair of
the word stands in the merge table. Further places of that pair to the right, which would come next, are contracted in
the same step wherever no pair with the merged token has a lower rank, so a word of any length takes as many steps
as it has different ranks. An ordered aggregation gives the ids of each word; texts are then put together from their words
in order. A task finds words it knows by a hash and compares their characters, so a chance collision changes nothing.

No shuffle: the only thing that travels to the executors is the merge table, whose size is fixed by the tokenizer
(about 50,000 rows, asserted below ``MAX_MERGES``).

Defined results: null text -> empty list; empty text -> empty list; white space, control characters and text that
looks like a special token are ordinary text; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.session import ship_package, spread

TOKENIZER_DIR = "/opt/tokenizers"
MAX_MERGES = 500_000
#: Words kept between tasks of one Python worker; beyond that the memory of words starts afresh (results don't change).
CACHE_WORDS = 300_000
#: Letters, numbers, white space and all other code points, as the tokenizer's word pattern tells them apart.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points of white space; fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings split off after an apostrophe; fixed values.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point, as UINT8; 1.1 MB, sent to the executors."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


def word_bounds(code: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where each word starts, and the end: of texts that stand one after another, as code points, and end at ``ends``.

    A word is a run of letters, of numbers or of other characters, with one blank before it if there is one; of white
    space before a word only that last blank belongs to it, and another last character stands alone. A lone apostrophe
    not after a blank takes one of ``ENDINGS`` with it.
    """
    n = len(code)
    kind = classes[code]
    first = np.zeros(n + 1, bool)  # first character of a text
    first[0] = True
    first[ends] = True
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    word_at = np.flatnonzero(start & (kind != SPACE) & ~first[:-1])  # words after something in the same text
    blank = word_at[code[word_at - 1] == 0x20]
    other_space = word_at[(kind[word_at - 1] == SPACE) & (code[word_at - 1] != 0x20)]
    marks = np.flatnonzero(start & (code == 0x27))
    marks = marks[(marks + 1 < n)]
    after_blank = np.zeros(n, bool)
    after_blank[blank] = True
    marks = marks[~after_blank[marks] & ~first[marks + 1]]
    start[blank] = False
    start[blank - 1] = True
    start[other_space - 1] = True
    if len(marks):
        nxt, after = code[marks + 1], np.where((marks + 2 < n) & ~first[np.minimum(marks + 2, n)], code[np.minimum(marks + 2, n - 1)], 0)
        for ending in ENDINGS:
            hit = nxt == ord(ending[0])
            if len(ending) == 2:
                hit &= after == ord(ending[1])
            at = marks[hit]
            start[at + 1] = False
            at = at[at + 1 + len(ending) < n] + 1 + len(ending)
            start[at] = True
    return np.append(np.flatnonzero(start), n)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the tokenizer's file: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(path: str) -> dict[str, np.ndarray]:
    """The tokenizer file as arrays: ``byte_id`` (id of each byte), ``left``, ``right``, ``merged`` ids in order of rank, and the classes of code points."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    byte_id = np.zeros(256, np.int32)
    for symbol, b in byte_symbols().items():
        byte_id[b] = vocab[symbol]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(pairs) > MAX_MERGES:
        raise ValueError(f"{len(pairs)} merges; at most {MAX_MERGES} are sent to executors")
    return {
        "byte_id": byte_id,
        "left": np.array([vocab[a] for a, _ in pairs], np.int32),
        "right": np.array([vocab[b] for _, b in pairs], np.int32),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int32),
        "classes": char_classes(),
    }


#: Each step contracts the least pair of every word, from the left; the key of the recursion is the word, so only its last state is kept.
#: A hit is its rank and, in the lower 32 bits, its place. Hits of a pair of equal tokens may overlap: of a run of neighbouring
#: places, whose place less number is the same, every second one is taken.
WORD_SQL = """
WITH RECURSIVE state(w, toks) USING KEY (w) AS (
    SELECT w, toks FROM words
    UNION
    SELECT w, CASE WHEN len(spots) = 1 THEN toks[:spots[1] - 1] || [merged] || toks[spots[1] + 2:]
        ELSE flatten(list_transform(range(0, len(spots) + 1), lambda i:
            toks[CASE WHEN i = 0 THEN 1 ELSE spots[i] + 2 END : CASE WHEN i = len(spots) THEN len(toks) ELSE spots[i + 1] - 1 END]
            || CASE WHEN i = len(spots) THEN CAST([] AS INTEGER[]) ELSE [merged] END)) END
    FROM (
        SELECT w, toks, merged, CASE WHEN alone OR len(places) = 1 THEN places[:1]
            ELSE list_filter(places, lambda x, i: (i - list_position(runs, x - i)) % 2 = 0) END AS spots
        FROM (
            SELECT *, list_transform(places, lambda x, i: x - i) AS runs
            FROM (
                SELECT w, toks, merged, alone, list_transform(list_sort(list_filter(hits, lambda x: x >> 32 = least >> 32)), lambda x: x & 4294967295) AS places
                FROM (
                    SELECT t.w, any_value(t.toks) AS toks, min((m.rank << 32) + t.p) AS least, list((m.rank << 32) + t.p) AS hits, arg_min(m.merged, m.rank) AS merged, arg_min(m.alone, m.rank) AS alone
                    FROM (SELECT w, toks, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS p FROM state WHERE len(toks) > 1) t
                    JOIN merges m ON m.l = t.l AND m.r = t.r
                    GROUP BY t.w
                )
            )
        )
    )
)
SELECT w, toks FROM state ORDER BY w
"""


def lone_merges(left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> np.ndarray:
    """Which merges make a token that a merge of lower rank takes up, so that only one place is contracted at a time."""
    first = np.full(int(max(left.max(initial=0), right.max(initial=0), merged.max(initial=0))) + 1, len(merged), np.int64)
    rank = np.arange(len(merged))
    np.minimum.at(first, left, rank)
    np.minimum.at(first, right, rank)
    return first[merged] < rank


class WordEncoder:
    """Ids of words by recursive queries; remembers words it has seen."""

    def __init__(self, merges: dict[str, np.ndarray]):
        import duckdb

        self.classes = merges["classes"]
        self.byte_id = merges["byte_id"]
        self.power = np.zeros(0, np.uint64)
        self.forget()
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        table = pa.table({"l": merges["left"], "r": merges["right"], "merged": merges["merged"], "rank": np.arange(len(merges["left"]), dtype=np.int64), "alone": lone_merges(merges["left"], merges["right"], merges["merged"])})
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")

    def forget(self) -> None:
        self.keys, self.flat, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.starts, self.lens, self.code_starts, self.code_lens = (np.zeros(0, np.int64) for _ in range(4))
        self.others: dict[str, list[int]] = {}  # words whose hash another word has

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the hash's base and of its inverse modulo 2^64."""
        if len(self.power) < n:
            base = 0x9E3779B97F4A7C15
            self.power, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        return self.power[:n], self.inverse

    def learn(self, words: list[str]) -> list[list[int]]:
        """The ids of words, by a recursive query."""
        toks = [self.byte_id[np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8)] for w in words]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int32)
        table = pa.table({"w": np.arange(len(words)), "toks": pa.ListArray.from_arrays(offsets, np.concatenate(toks))})
        self.db.register("words", table)
        got = self.db.execute(WORD_SQL).fetchall()
        self.db.unregister("words")
        return [ids for _, ids in got]

    def remember(self, keys: np.ndarray, words: list[str]) -> None:
        """Add new words, given with their hashes, to the sorted table of known ones."""
        ids = self.learn(words)
        lens, code_lens = np.array([len(x) for x in ids], np.int64), np.array([len(w) for w in words], np.int64)
        starts, code_starts = np.cumsum(lens) - lens + len(self.flat), np.cumsum(code_lens) - code_lens + len(self.codes)
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))])
        self.codes = np.concatenate([self.codes, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys = keys[order]
        for name, own in (("starts", starts), ("lens", lens), ("code_starts", code_starts), ("code_lens", code_lens)):
            setattr(self, name, np.concatenate([getattr(self, name), own])[order])

    def mistaken(self, code: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the words (from ``left`` to ``right`` of ``code``, one after another) that differ from the known word of the same hash."""
        same = self.code_lens[at] == right - left
        n = np.where(same, right - left, 0)
        place = np.repeat(self.code_starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own = code if same.all() else code[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        differ = np.flatnonzero(self.codes[place] != own)
        wrong = ~same
        wrong[np.searchsorted(np.cumsum(n), differ, "right")] = True
        return np.flatnonzero(wrong)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and the ids of all texts. Words are found by a 64-bit hash of their code points, which are then compared."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(code):
            return np.zeros(len(texts) + 1, np.int32), np.zeros(0, np.int32)
        bounds = word_bounds(code, ends, self.classes)
        power, inverse = self.powers(len(code))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power)])
        left, right = bounds[:-1], bounds[1:]
        key = (total[right] - total[left]) * inverse[left]
        key ^= key >> np.uint64(29)
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        missing = np.flatnonzero(self.keys[at] != key) if len(self.keys) else np.arange(len(key))
        if len(missing):
            new, where = np.unique(key[missing], return_index=True)
            where = missing[where]
            self.remember(new, [joined[i:j] for i, j in zip(left[where].tolist(), right[where].tolist(), strict=True)])
            at = np.searchsorted(self.keys, key)
        starts, lens, flat = self.starts[at], self.lens[at], self.flat
        wrong = self.mistaken(code, left, right, at)
        if len(wrong):
            words = [joined[i:j] for i, j in zip(left[wrong].tolist(), right[wrong].tolist(), strict=True)]
            new = [w for w in dict.fromkeys(words) if w not in self.others]
            if new:
                self.others.update(zip(new, self.learn(new), strict=True))
            own = [self.others[w] for w in words]
            lens[wrong] = [len(x) for x in own]
            starts[wrong] = len(flat) + np.cumsum(lens[wrong]) - lens[wrong]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(own), np.int32)])
        reach = np.concatenate([[0], np.cumsum(lens)])
        ids = flat[np.repeat(starts - reach[:-1], lens) + np.arange(reach[-1])]
        per_text = np.searchsorted(bounds, np.concatenate([[0], ends]))
        return reach[per_text].astype(np.int32), ids


_encoders: dict[int, WordEncoder] = {}


def _encoder(key: int, merges: dict[str, np.ndarray]) -> WordEncoder:
    """The encoder of this Python worker; made once per worker and merge table."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(merges)
    return _encoders[key]


#: Characters encoded at a time, so that a task's memory doesn't follow the batch.
BLOCK_CHARS = 400_000


def encode_table(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(``id_col``, ids ARRAY<INT>) for every row of ``df``; see the module's text for the defined results."""
    spark = df.sparkSession
    ship_package(spark)
    merges = read_merges(os.path.join(tokenizer_dir, f"{tokenizer}.json"))
    key = hash((tokenizer, tokenizer_dir, len(merges["left"]), int(merges["merged"].sum())))
    sent = spark.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(key, sent.value)
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end] or "") <= BLOCK_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                offsets, flat = encoder.encode([t or "" for t in texts[start:end]])
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), out], names=[id_col, "ids"])
                start = end

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
