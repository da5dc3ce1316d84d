"""Benchmark decontamination: word bounds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, bounded_batches, in_slices, releasing

#: Words of the shortest item, and the share of a perfect alignment's score that counts as a leak.
ITEM_WORDS, LEAK = 3, 0.5
#: The scores of a match, a mismatch and a gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the place where an alignment starts, an item's word times the words of a stretch.
_START_BITS = 44
#: Items and their bytes that go to the workers at a time; a larger benchmark is searched for in several passes.
ITEMS, ITEM_BYTES = 20_000, 16 << 20

LEAKS = "doc_id long, item_id long, score double, start_word long, end_word long, item_start long, item_end long"


def align(query: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int, int]:
    """(score, start, end, start in text, end in text) of the best local alignment; one numpy step for each word of query.

    A gap along the text is a running maximum: the best score so far, less the distance. A cell holds its score and, below it, where
    its alignment starts, so no table is kept: memory is that of two rows. Of equal scores the later start wins, and the earlier end.
    """
    n = len(text)
    unit = 1 << _START_BITS
    far = np.arange(n + 1) * (GAP * unit)
    above = np.arange(n + 1)
    best = (0, 0, 0, 0)
    for i, word in enumerate(query.tolist(), 1):
        row = above + GAP * unit
        np.maximum(row[1:], above[:-1] + np.where(text == word, MATCH * unit, MISMATCH * unit), out=row[1:])
        np.maximum(row, np.arange(i * (n + 1), (i + 1) * (n + 1)), out=row)
        above = np.maximum.accumulate(row - far) + far
        top = int(above.max()) >> _START_BITS
        if top > best[0]:
            at = int(np.argmax(above >= top * unit))
            best = (top, int(above[at]) & (unit - 1), i, at)
    score, start, end, end_text = best
    return score, start // (n + 1), end, start % (n + 1), end_text


def folded(text: bytes) -> list[bytes]:
    """Words in lower case, of any script: a copy in capitals is a copy."""
    return text.split() if text.islower() and text.isascii() else text.decode("utf-8", "replace").lower().encode().split()


class Items:
    """The words of a set of items, numbered from 1, and for each word the items that have it."""

    def __init__(self, items: list[tuple[int, bytes]], least: float, item_words: int) -> None:
        self.vocabulary, self.ids, self.words = {}, [], []
        for item_id, text in items:
            own = folded(text)
            if own:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], np.int64))
        self.kinds = [np.unique(w, return_counts=True) for w in self.words]
        self.short = np.array([len(w) < item_words for w in self.words], bool)
        self.need = np.array([least * MATCH * len(w) for w in self.words])
        item = np.repeat(np.arange(len(self.words)), [len(k) for k, _ in self.kinds])
        word = np.concatenate([k for k, _ in self.kinds]) if self.kinds else np.zeros(0, np.int64)
        many = np.concatenate([n for _, n in self.kinds]) if self.kinds else np.zeros(0, np.int64)
        by = np.argsort(word, kind="stable")
        self.item, self.many = item[by], many[by]
        self.start = np.searchsorted(word[by], np.arange(len(self.vocabulary) + 2))

    def number(self, text: bytes) -> np.ndarray:
        """Words as numbers, 0 where no item has one."""
        words, get = folded(text), self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def near(self, words: np.ndarray) -> np.ndarray:
        """The items of which the text has enough words, as often as the item, for the least score to be in reach."""
        known = np.sort(words[words > 0])
        if not len(known):
            return known
        at = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
        times = np.diff(np.append(at, len(known)))
        low = self.start[known[at]]
        n = self.start[known[at] + 1] - low
        post = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.item[post], np.minimum(self.many[post], np.repeat(times, n)), len(self.words))
        return np.flatnonzero(MATCH * shared >= self.need)

    def stretches(self, i: int, words: np.ndarray, mark: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first, end) of the stretches that hold every alignment of item i with the least score; mark is False for each word.

        A text word gains MATCH at most where the item has it, and costs a mismatch or a gap elsewhere, so an alignment's
        score is at most the sum of these over its words. Words within no run of a large enough sum are left out.
        """
        own = self.kinds[i][0]
        mark[own] = True
        gain = np.where(mark[words], MATCH, max(MISMATCH, GAP))
        mark[own] = False
        total = np.concatenate([[0], np.cumsum(gain)])
        ending = total[1:] - np.minimum.accumulate(total[:-1])
        if ending.max() < self.need[i]:
            return
        starting = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        inside = (ending + starting - gain >= self.need[i]).astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
        yield from zip(edge[::2].tolist(), edge[1::2].tolist())

    def aligned(self, i: int, words: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(score, start, end, start in the item, its end) of the alignments of item i within words[a:b]: the best one, then those on both sides of it."""
        own, many = self.kinds[i]
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            stretch = words[a:b]
            there = np.bincount(np.minimum(np.searchsorted(own, stretch), len(own) - 1)[np.isin(stretch, own)], minlength=len(own))
            if MATCH * np.minimum(there, many).sum() < self.need[i]:
                continue
            score, c, d, e, f = align(self.words[i], stretch)
            if score > 0 and score >= self.need[i]:
                yield score, a + e, a + f, c, d
                todo += [(a, a + e), (a + f, b)]


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, as many at a time as may be held."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary")).where("item_id is not null and text is not null")
    held, size = [], 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((item_id, bytes(text)))
        size += len(text)
        if len(held) >= ITEMS or size >= ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAK, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, item_start, item_end): passages of documents that align with a benchmark item at `least` of the perfect score or better.

    Words are [^\\x20\\x09-\\x0D]+ in lower case; ends are exclusive. One pass over all documents aligns every item with the stretches
    where two bounds let the score be reached: the words a document shares with the item, and the gain of a stretch's words less the cost of the
    others. Both are exact, so edits, wherever they are, hide no passage. Passages of one item in one document don't overlap: the best is taken first.
    An item of fewer than item_words words is found only where a document's words are its own. An empty table of documents or items gives no rows. Memory goes with the sum of an
    item's and a stretch's words, not their product. Null and empty texts, items of no word, and null ids of items have no rows; a null doc_id stays null; rows repeat as the input does; other columns are
    ignored. Nothing is shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for items in _chunks(benchmark):
        part = _leaks(own, Items(items, least, item_words))
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], LEAKS) if out is None else out


def _leaks(docs: DataFrame, items: Items) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        mark = np.zeros(len(s.vocabulary) + 1, bool)
        for batch in in_slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                words = s.number(text)
                for i in s.near(words).tolist():
                    if s.short[i]:
                        if np.array_equal(words, s.words[i]):
                            rows.append((doc_id, s.ids[i], 1.0, 0, len(words), 0, len(words)))
                        continue
                    for a, b in s.stretches(i, words, mark):
                        rows += [(doc_id, s.ids[i], score / (MATCH * len(s.words[i])), *at) for score, *at in s.aligned(i, words, a, b)]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 2 else pa.int64()) for k, c in enumerate(columns)], [c.split()[0] for c in LEAKS.split(", ")])

    return docs.mapInArrow(search, LEAKS)
