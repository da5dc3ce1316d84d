"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts, walked as flat arrays."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, bounded_batches, cut, in_slices, releasing

#: Labelled rows that a model is fitted on, at most; those of the smallest hashes.
TRAINING_ROWS = 20_000
#: Names of the statistics, in the order of a row of features.
FEATURES = "log_bytes log_words word_bytes distinct_words top_word longest_run repeats upper digits spaces other_ascii high_bytes pipes hashes bangs symbols_in_words mean_line repeated_lines longest_line ends sentence_words capitals entropy deflate short_words distinct_pairs".split()
_MARKS = b"&$%#*@|<>{}[]\\^~_=+"


def statistics(text: bytes) -> list[float]:
    """Features of one whole text; an empty one has zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    m = len(words)
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = at / n
    counts = Counter(words)
    same = [a == b for a, b in zip(words, words[1:])]
    run = longest = 1
    for s in same:
        run = run + 1 if s else 1
        longest = max(longest, run)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = at[46] + at[33] + at[63]
    p = share[share > 0]
    sampled = zlib.compress(text, 1)
    return [
        np.log1p(n), np.log1p(m), sum(map(len, words)) / m, len(counts) / m, max(counts.values()) / m, longest / m, sum(same) / m,
        share[65:91].sum(), share[48:58].sum(), share[32], share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum(), share[128:].sum(),
        at[124] / m, at[35] / m, at[33] / m, sum(at[c] for c in _MARKS) / m,
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, lines), default=0)),
        ends / m, np.log1p(m / (1 + ends)), sum(w[:1].isupper() for w in words) / m, float(-(p * np.log2(p)).sum()), len(sampled) / n,
        sum(len(w) <= 2 for w in words) / m, len(set(zip(words, words[1:]))) / m,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one double for each of FEATURES) of every row; null and empty texts have zeros. Narrow."""
    bounded_batches(docs.sparkSession)

    @releasing
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            x = np.array([statistics(t) for t in blobs(batch.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], ["id", *FEATURES])

    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(measure, "id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Trees:
    """Flat arrays (tree, node): the feature and threshold of a split, its children, and a leaf's value. A leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Every row walks every tree at once, one level at a time."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for a in range(0, len(x) if len(trees) else 0, 4096):
            rows = x[a : a + 4096]
            node = np.zeros((len(rows), len(trees)), np.int64)
            for _ in range(self.depth):
                right = rows[np.arange(len(rows))[:, None], self.feature[trees, node]] > self.threshold[trees, node]
                node = np.where(right, self.right[trees, node], self.left[trees, node])
            out[a : a + 4096] += self.value[trees, node].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 5, rate: float = 0.12, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosting with the logistic loss; features are binned once at their quantiles, and a level's gradient histograms come from one bincount for each feature."""
    n, d = x.shape
    positive = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(positive / (1 - positive)))
    width = 2 ** (depth + 1) - 1
    rounds = rounds if n and 0 < y.sum() < n else 0
    shape = (rounds, width)
    self_node = np.tile(np.arange(width), (rounds, 1))
    trees = Trees(np.zeros(shape, np.int64), np.full(shape, np.inf), self_node.copy(), self_node.copy(), np.zeros(shape), base, depth)
    if not rounds:
        return trees
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)])  # x > edge i exactly when the bin is over i
    margin = np.full(n, base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            own = node - first
            live = own >= 0
            own_live, g_live, h_live = own[live], g[live], h[live]
            gain = np.zeros((count, d))
            where = np.zeros((count, d), np.int64)
            for j in range(d):
                key = own_live * bins + binned[j, live]
                hist = [np.bincount(key, w, count * bins).reshape(count, bins) for w in (g_live, h_live, None)]
                gl, hl, nl = (np.cumsum(q, axis=1) for q in hist)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gains = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gains[(nl < least) | (nt - nl < least)] = 0
                gains[:, len(edges[j]) :] = 0
                where[:, j] = gains.argmax(axis=1)
                gain[:, j] = gains.max(axis=1)
            best = gain.argmax(axis=1)
            split = np.flatnonzero(gain[np.arange(count), best] > 1e-9)
            for k in split.tolist():
                j, at = int(best[k]), first + k
                trees.feature[t, at], trees.threshold[t, at] = j, edges[j][where[k, j]]
                trees.left[t, at], trees.right[t, at] = 2 * at + 1, 2 * at + 2
            moved = live & np.isin(own, split)
            at = node[moved]
            node[moved] = 2 * at + 1 + (x[moved, trees.feature[t, at]] > trees.threshold[t, at])
        gs, hs = np.bincount(node, g, width), np.bincount(node, h, width)
        trees.value[t] = -rate * gs / (hs + ridge)
        margin += trees.value[t, node]
    return trees


def train(measured: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Fits on at most `rows` labelled rows, those of the smallest id hashes among the usable ones, so the driver's share is bounded; null labels and ids are left out."""
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    one = measured.join(known, "id").groupBy("id", "label").agg(F.min(F.struct(*FEATURES)).alias("of"))  # a repeated id has one row
    got = one.select("id", "label", "of.*").toArrow()
    table = np.stack([got.column(c).to_numpy() for c in ["id", "label", *FEATURES]], axis=1)
    table = table[np.lexsort(table.T[::-1])]  # the same fit, whatever order the rows come in
    return fit(table[:, 2:], table[:, 1])


def classify(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, score) of every row: how likely its whole text has label 1.

    Only the text is an input of a score. Without labels of both kinds the score is the share of label 1, 0.5 for
    none. Null and empty texts are scored as zero statistics; repeated rows get equal scores; other columns
    are ignored. Features are measured once, into the shared folder; the trees are a few hundred kB however large the corpus is.
    """
    spark = docs.sparkSession
    measured = cut(features(docs), "features")
    model = spark.sparkContext.broadcast(train(measured, labels, usable, label_col, rows))

    @releasing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy() for k in range(1, batch.num_columns)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(x))], ["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double")
