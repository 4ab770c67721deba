"""Evaluation texts that stand, wholly or partly, in a training corpus.

Method: rare n-gram seeds join passages to test items, then Smith-Waterman alignment scores edited copies. In every
window of ``run`` consecutive words of an item (the whole item if it is shorter) the n-gram that is rarest in the corpus
becomes a seed; so any passage that holds the window holds its seed, and no true case is lost, whatever is common. The
corpus is read twice: once to count the items' n-grams in all documents, once to find seeds. Around each seed the
passage is aligned with the item, word by word, and the alignment's score decides: a document leaks an item if it reaches
the score of ``run`` equal words in sequence (of all words of a shorter item). Since such a run alone has that score, no
document that holds one is lost. ``p8_found`` wants the words in sequence without edits, so among the documents that the
score accepts an exact check follows: the longest run on a diagonal of the same table.

An edit breaks every n-gram across it, so for edited copies (``p8_scores``) all n-grams of an item are seeds and the
corpus is read once. A copy of an item of n words with k words changed, left out or put in keeps an n-gram of
``SEED_WORDS`` words wherever n >= SEED_WORDS * (k + 1): up to (n - 4) / 4 edits in any places are found, more where they
leave four words together. The score is that of the best alignment that holds a seed; the passage around a seed
reaches as far as such an alignment can. ``edited_copies`` accepts what scores at least ``EDITED_PERMILLE`` of a whole copy:
one edit costs at most three words' worth (a changed word: its own match and a mismatch), so of n >= 9 words up to 2 n / 15
may be changed at any places.

Items are few against the corpus: their words, n-grams and seeds go to the tasks below ``MAX_ITEM_WORDS`` words in all;
more items are worked off in blocks of that size, each a pass of its own.

Defined results: null or empty texts and items without words hold nothing; an item's words count in lower case (ASCII);
repeated documents are reported each, repeated item ids are one item (the smallest text); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.words import FOLDED, words_of
from lodestrata.session import ship_package, spread

RUN = 12
SEED_WORDS = 4
MAX_ITEM_WORDS = 2_000_000
#: Words of passages that wait to be aligned in a task, and of those aligned at once.
MAX_WAITING, MAX_CELLS = 2_000_000, 200_000
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score against a whole copy's from which a document counts as an edited copy of an item.
EDITED_PERMILLE = 800


class Items:
    """Words of the items as numbers, and their n-grams."""

    def __init__(self, rows: list[tuple[int, str]], run: int, seed_words: int):
        self.vocab: dict[bytes, int] = {}
        self.run, self.n = run, seed_words
        self.items: dict[int, np.ndarray] = {}
        for item_id, text in rows:
            words = words_of(text, FOLDED)
            if words:
                self.items[item_id] = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)

    def width(self, item: np.ndarray) -> int:
        return min(self.n, len(item))

    def grams(self) -> dict[tuple, int]:
        """Number of every distinct n-gram of the items."""
        out: dict[tuple, int] = {}
        for item in self.items.values():
            w = self.width(item)
            for k in range(len(item) - w + 1):
                out.setdefault(tuple(item[k : k + w].tolist()), len(out))
        return out

    def all_seeds(self) -> dict[tuple, list[tuple[int, int]]]:
        """Every n-gram: n-gram -> [(item, place)]."""
        out: dict[tuple, list] = {}
        for item_id, item in self.items.items():
            w = self.width(item)
            for k in range(len(item) - w + 1):
                out.setdefault(tuple(item[k : k + w].tolist()), []).append((item_id, k))
        return out

    def seeds(self, grams: dict[tuple, int], count: dict[int, int]) -> dict[tuple, list[tuple[int, int]]]:
        """The rarest n-gram of each window: n-gram -> [(item, place)]."""
        out: dict[tuple, dict] = {}
        for item_id, item in self.items.items():
            w = self.width(item)
            all_grams = [tuple(item[k : k + w].tolist()) for k in range(len(item) - w + 1)]
            rank = [(count.get(grams[g], 0), grams[g], k) for k, g in enumerate(all_grams)]
            per_window = min(self.run, len(item)) - w + 1
            for i in range(len(all_grams) - per_window + 1):
                k = min(rank[i : i + per_window])[2]
                out.setdefault(all_grams[k], {})[item_id, k] = None
        return {g: list(places) for g, places in out.items()}


class GramFinder:
    """Finds given n-grams in sequences of word numbers (0: no item's word)."""

    def __init__(self, grams: dict[tuple, int]):
        self.by_width = {}
        for w in {len(g) for g in grams}:
            own = [g for g in grams if len(g) == w]
            keys = self._key(np.array(own, np.int64).T)
            order = np.argsort(keys)
            self.by_width[w] = (keys[order], np.array([grams[own[k]] for k in order], np.int64))

    @staticmethod
    def _key(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1], np.uint64)
        for c in columns:
            out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out

    def find(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, n-gram number) of every hit."""
        places, numbers = [], []
        known = seq > 0
        for w, (keys, ids) in self.by_width.items():
            m = len(seq) - w + 1
            if m <= 0:
                continue
            ok = known[:m].copy()
            for k in range(1, w):
                ok &= known[k : k + m]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            got = self._key(np.stack([seq[at + k] for k in range(w)]))
            pos = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            hit = keys[pos] == got
            places.append(at[hit])
            numbers.append(ids[pos[hit]])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(numbers)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(Smith-Waterman score, longest run of equal words in sequence) of an item and a passage."""
    best, longest = align_many(item, [passage])
    return int(best[0]), int(longest[0])


def align_many(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many passages at once, as one padded table."""
    width = max(len(p) for p in passages)
    table = np.full((len(passages), width), -1, np.int32)  # no word's number
    for row, p in zip(table, passages, strict=True):
        row[: len(p)] = p
    score, best = np.zeros((len(passages), width + 1), np.int32), np.zeros(len(passages), np.int32)
    run, longest = np.zeros_like(score), np.zeros_like(best)
    steps = np.arange(width + 1, dtype=np.int32)
    for w in item:
        same = table == w
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        np.maximum(longest, run.max(axis=1), out=longest)
        new = np.zeros_like(score)
        new[:, 1:] = np.maximum(score[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), score[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        # gaps along the passage: the best earlier score less one for each step
        score = np.maximum.accumulate(new - GAP * steps, axis=1) + GAP * steps
        np.maximum(best, score.max(axis=1), out=best)
    return best, longest


def _sequences(batches: Iterator[pa.RecordBatch], vocab: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
    number = vocab.get
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text, FOLDED)
            if words:
                yield doc, np.fromiter((number(w, 0) for w in words), np.int64, len(words))


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", run: int = RUN, seed_words: int = SEED_WORDS, edited: bool = False) -> DataFrame:
    """(doc_id, item_id, score, score_permille, longest_run, item_words) of every document and item that share a seed.

    ``score`` is the best alignment's, ``score_permille`` its part of a full copy's. ``longest_run`` is exact: the largest
    number of consecutive words of the item that the document holds in sequence, wherever it is at least ``run`` (or the
    item's length). With ``edited`` every n-gram of an item is a seed, so edited copies come out too.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = items.filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item_col).cast("bigint").alias("i")).agg(F.min(item_text).alias("t"))
    # bounded by MAX_ITEM_WORDS for each pass; the test items are a fixed set, not the corpus
    blocks, block, size = [], [], 0
    for r in rows.orderBy("i").toLocalIterator():
        n = len(words_of(r["t"], FOLDED))
        if block and size + n > MAX_ITEM_WORDS:
            blocks.append(block)
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    blocks.append(block)
    out = None
    for block in blocks:
        one = _leaks_of_block(docs.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), Items(block, run, seed_words), edited)
        out = one if out is None else out.unionByName(one)
    return out


def _rarest(docs: DataFrame, items: Items) -> dict[tuple, list[tuple[int, int]]]:
    """Seeds by the n-grams' counts in all documents."""
    spark = docs.sparkSession
    grams = items.grams()
    sent_vocab = spark.sparkContext.broadcast((items.vocab, grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, grams = sent_vocab.value
        finder, total = GramFinder(grams), np.zeros(len(grams), np.int64)
        for _, seq in _sequences(batches, vocab):
            total += np.bincount(finder.find(seq)[1], minlength=len(grams))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    # one row for each n-gram of the items
    counted = {r["gram"]: r["n"] for r in docs.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()} if grams else {}
    return items.seeds(grams, counted)


def _leaks_of_block(docs: DataFrame, items: Items, edited: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = spread(docs)
    seeds = items.all_seeds() if edited else _rarest(docs, items)
    numbers = {g: k for k, g in enumerate(seeds)}
    sent = spark.sparkContext.broadcast((items.vocab, items.items, numbers, list(seeds.values())))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, texts, numbers, places = sent.value
        finder = GramFinder(numbers)
        wait: dict[int, list[tuple[int, list[np.ndarray]]]] = {}  # item -> documents and their passages
        cells = 0
        for doc, seq in _sequences(batches, vocab):
            at, number = finder.find(seq)
            spans: dict[int, set[tuple[int, int]]] = {}
            for a, k in zip(at.tolist(), number.tolist(), strict=True):
                for item_id, place in places[k]:
                    lo = a - place
                    spans.setdefault(item_id, set()).add((lo, lo + len(texts[item_id])))
            for item_id, found in spans.items():
                # a word that matches pays for two gaps, so an alignment that holds the seed ends within this
                slack = len(texts[item_id]) * MATCH // -GAP
                merged: list[list[int]] = []
                for lo, hi in sorted(found):
                    lo, hi = max(0, lo - slack), min(len(seq), hi + slack)
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                wait.setdefault(item_id, []).append((doc, [seq[lo:hi] for lo, hi in merged]))
                cells += sum(hi - lo for lo, hi in merged)
            if cells > MAX_WAITING:
                yield _leak_batch(_scored(texts, wait))
                wait, cells = {}, 0
        yield _leak_batch(_scored(texts, wait))

    return docs.mapInArrow(find, "doc_id bigint, item_id bigint, score bigint, score_permille bigint, longest_run bigint, item_words bigint").distinct()


def _scored(texts: dict[int, np.ndarray], wait: dict[int, list[tuple[int, list[np.ndarray]]]]) -> list[tuple]:
    """Rows of the documents that wait for each item; passages of like length are aligned together."""
    rows = []
    for item_id, docs in wait.items():
        item = texts[item_id]
        best, longest = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        order = sorted(((len(p), k, j) for k, (_, passages) in enumerate(docs) for j, p in enumerate(passages)))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and order[end][0] <= 2 * order[start][0] and order[end][0] * (end + 1 - start) <= MAX_CELLS:
                end += 1
            score, run = align_many(item, [docs[k][1][j] for _, k, j in order[start:end]])
            owner = [k for _, k, _ in order[start:end]]
            np.maximum.at(best, owner, score)
            np.maximum.at(longest, owner, run)
            start = end
        rows += [(doc, item_id, int(b), int(b) * 1000 // (MATCH * len(item)), int(r), len(item)) for (doc, _), b, r in zip(docs, best, longest, strict=True)]
    return rows


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "score", "score_permille", "longest_run", "item_words"])


def accepted(found: DataFrame, run: int = RUN) -> DataFrame:
    """Rows whose alignment scores at least as much as ``run`` words in sequence, or all words of a shorter item."""
    return found.filter(F.col("score") >= MATCH * F.least(F.lit(run), F.col("item_words")))


def leaked(found: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id) that the alignment accepts and that hold those words in sequence without edits."""
    return accepted(found, run).filter(F.col("longest_run") >= F.least(F.lit(run), F.col("item_words"))).select("doc_id", "item_id")


def edited_copies(found: DataFrame, permille: int = EDITED_PERMILLE) -> DataFrame:
    """(doc_id, item_id, score_permille) of documents that hold an item wholly, edited or not, by the score of the alignment."""
    return found.filter(F.col("score_permille") >= permille).select("doc_id", "item_id", "score_permille")
