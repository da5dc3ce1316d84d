"""Best-fit packing of documents into sequences: patterns of few lengths by non-negative least squares.

Everything the driver holds is a function of the capacity, not of the corpus: the histogram of piece
lengths has at most `capacity` rows, and a plan is a list of patterns with repeat counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pretokens
from .common import bounded_batches, cut, in_slices, releasing, shuffles

#: Patterns that are enumerated for each length with partners of two or more.
PARTNERS = 24


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and end_id, cut into pieces of capacity ids if longer, of which the first may be shorter."""
    bounded_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    @releasing
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pretokens.ids_of(tokenizer_path).of
        for batch in in_slices(batches):
            ids, ks, starts, lengths, crcs = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = of(text or "") + end
                n = len(tokens) // 4
                at, k = 0, 0
                while at < n:
                    size = capacity if k or n % capacity == 0 else n % capacity
                    ids.append(doc_id)
                    ks.append(k)
                    starts.append(at)
                    lengths.append(size)
                    crcs.append(zlib.crc32(tokens[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return picked.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Lengths that fill a sequence, or nearly: each length with its best partner, and with partners of two and three of what is left."""
    have = np.flatnonzero(counts)
    fit = np.zeros(capacity + 1, np.int64)  # the longest length there is that is at most i
    fit[have] = have
    fit = np.maximum.accumulate(fit)
    found: set[tuple[int, ...]] = set()
    by_count = have[np.argsort(-counts[have], kind="stable")]
    for a in have.tolist():
        rest = capacity - a
        if (b := int(fit[rest])) == 0:
            found.add((a,))
            continue
        found.add(tuple(sorted((a, b), reverse=True)))
        inner = by_count[by_count < rest]
        spread = have[have < rest]
        for b in {*inner[:PARTNERS].tolist(), *spread[np.linspace(0, len(spread) - 1, min(len(spread), PARTNERS)).astype(int)].tolist()}:
            if c := int(fit[rest - b]):
                found.add(tuple(sorted((a, b, c), reverse=True)))
                left = rest - b - c
                if left and (d := int(fit[left])):
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def nnls(found: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum over patterns of x * (its lengths) near the histogram: cyclic coordinate descent would be serial, so this is projected gradient with momentum on the sparse system."""
    rows = np.concatenate([np.array(p) for p in found])
    cols = np.repeat(np.arange(len(found)), [len(p) for p in found])
    target = counts.astype(float)
    weight = 1 / np.sqrt(np.maximum(target, 1))  # rare lengths matter as much as frequent ones
    apply = lambda x: np.bincount(rows, x[cols], len(counts))
    back = lambda r: np.bincount(cols, r[rows], len(found))
    v = np.ones(len(found))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(weight**2 * apply(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.05 * max(float(v @ back(weight**2 * apply(v))), 1e-12))
    x, y, t = (z := np.zeros(len(found))), z, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(weight**2 * (apply(y) - target)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on the histogram: equal sequences are filled together, so the work depends on the capacity alone."""
    counts = counts.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    while counts.any():
        pattern, rest = [], capacity
        while rest and (fits := np.flatnonzero(counts[: rest + 1])).size:
            pattern.append(a := int(fits[-1]))
            counts[a] -= 1
            rest -= a
        need = np.bincount(pattern, minlength=len(counts))
        used = np.flatnonzero(need)
        more = int((counts[used] // need[used]).min())
        counts -= more * need
        out.append((tuple(pattern), 1 + more))
    return out


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold each length of the histogram exactly as often as it occurs: the fitted repeats rounded down, then best fit for what they leave."""
    found = patterns(counts, capacity)
    if not found:
        return []
    repeats = np.floor(nnls(found, counts) + 1e-6).astype(np.int64)
    left, fitted = counts.copy(), []
    for k in np.lexsort((-repeats, [capacity - sum(p) for p in found])):  # the fullest first
        need = np.bincount(found[k], minlength=len(counts))
        used = np.flatnonzero(need)
        if n := int(min(repeats[k], (left[used] // need[used]).min())):
            left -= n * need
            fitted.append((found[k], n))
    return fitted + best_fit(left, capacity)


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, ranks a sequence, first sequence, first offset): the r-th piece of a length has its place by arithmetic."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, repeats in made:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            m = pattern.count(length)
            out.setdefault(length, []).append((ranks.get(length, 0), m, first, at))
            ranks[length] = ranks.get(length, 0) + m * repeats
            at += m * length
        first += repeats
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every text: see pieces(); sequences hold at most capacity ids without gaps.

    The histogram of lengths goes to the driver (capacity rows at most), the plan back to the workers. A
    piece's rank among those of its length is its rank in a block of documents plus the counts of the blocks
    before, so a length that many pieces share is not gathered in one task. Null and empty texts are a piece of
    one id; repeated rows are packed each; an empty table gives no rows; other columns are ignored. The pieces are
    written to the shared folder before ranks are given, so a lost executor changes none.
    """
    spark = docs.sparkSession
    blocks = 8 * shuffles(spark)
    cut_up = pieces(docs, tokenizer_path, capacity, end_id)
    kept = cut(cut_up.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")), "pieces")
    by_block = cut(kept.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_block.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = by_block.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    @releasing
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for a in np.unique(length).tolist():
                own, table = np.flatnonzero(length == a), places.value[a]
                row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                nth, within = np.divmod(rank[own] - row[:, 0], row[:, 1])
                seq[own], off[own] = row[:, 2] + nth, row[:, 3] + within * a
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
