"""A backoff n-gram model as a weighted automaton, learned from and applied to a whole corpus.

States are contexts, arcs carry the log10 probabilities of the n-grams that training texts have, and a failure arc leads
to the next shorter context with the weight that backing off costs. A text is scored in one traversal from left to right.

No worker holds the model. Documents are dealt into blocks; a block asks for the counts of its n-grams, gets
them from the buckets in which all blocks' training counts meet, and builds the part of the automaton that its own texts
can reach. What is asked and answered grows with the corpus; what a task holds doesn't.

Smoothing: p(w | context) = (c(context w) + S p(w | shorter context)) / (c(context) + S), down to
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). Of an n-gram that wasn't seen only S / (c(context) + S) times the shorter one remains,
so that factor is the failure arc's weight and the whole sums to 1 over the V words and an unknown one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, blobs, bounded_batches, mix, shuffles, tokens, word_hashes

#: The base's additive constant, the weight S of shorter contexts, and the longest n-gram.
ADD, SHORTER, ORDER = 0.1, 4.0, 3
#: Bytes of text in a block, at most but for a text that is longer.
BLOCK_BYTES = 8 << 20
#: The hash of the token that ends a text.
END = np.uint64(0xE0DE0DE0DE0DE0DE)
#: Bytes of a longer n-gram's key that travel within its bucket: 40 bits tell a bucket's n-grams apart, of which one in 2^40 over the bucket's n-grams has another one's key.
#: Single words travel apart from them and with all bits: exact counts, N and V rest on them.
KEY_BYTES = 5
REQUESTS = "bucket int, block int, words int, longer int, word_keys binary, longer_keys binary, counts binary"
ANSWERS = "block int, bucket int, counts binary, total long, kinds long"


@dataclass
class Level:
    """The block's distinct n-grams of one length: keys, for each token the number of the n-gram that ends there (-1: none), and training counts within the block."""

    keys: np.ndarray
    ends: np.ndarray
    trained: np.ndarray


class Block:
    """The tokens of some texts one behind the other, and their n-grams."""

    def __init__(self, texts: list[bytes], trained: np.ndarray, order: int, buckets: int) -> None:
        parts = [np.append(word_hashes(tokens(t)), END) for t in texts]
        self.bounds = np.cumsum([0, *map(len, parts)])
        hashes = np.concatenate(parts)
        place = np.arange(len(hashes)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        learned = np.repeat(trained, np.diff(self.bounds))
        self.levels: list[Level] = []
        rolling = np.zeros(0, np.uint64)
        for n in range(1, order + 1):
            rolling = hashes if n == 1 else mix(rolling[:-1] * MULTIPLIER + hashes[n - 1 :])  # of the n-gram that starts at each token
            own = np.flatnonzero(place >= n - 1)
            keys, number = np.unique(mix(rolling[own - n + 1] + np.uint64(n)), return_inverse=True)
            ends = np.full(len(hashes), -1, np.int64)
            ends[own] = number
            self.levels.append(Level(keys, ends, np.bincount(number[learned[own]], minlength=len(keys))))
        keys = np.concatenate([level.keys for level in self.levels])
        words = len(self.levels[0].keys)
        self.within = keys // np.uint64(buckets)
        self.within[words:] &= np.uint64((1 << 8 * KEY_BYTES) - 1)
        group = 2 * (keys % np.uint64(buckets)).astype(np.int64)
        group[words:] += 1
        self.by = np.lexsort((self.within, group))  # by bucket, in each the words first
        self.groups = np.searchsorted(group[self.by], np.arange(2 * buckets + 1))

    def part(self, bucket: int) -> tuple[np.ndarray, int]:
        """The n-grams of a bucket in the order of its request, and how many of them are words."""
        a, words, z = self.groups[2 * bucket : 2 * bucket + 3].tolist()
        return self.by[a:z], words - a


def _sent(within: np.ndarray) -> bytes:
    """Byte planes of the gaps between sorted keys, as many as the largest gap needs."""
    if not len(within):
        return b""
    gaps = np.diff(within, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(len(within), 8).T[:width]).tobytes()


def _got(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = len(data) // n
        out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes, with those over 254 in a list behind."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype(np.int64).tobytes()


def _widen(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sum of each distinct key's counts, and for each list of keys the sums in its order."""
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)
    return sums, np.split(sums[which], np.cumsum([len(k) for k in keys])[:-1])


def _in_order(table: pa.Table) -> pa.Table:
    """A block's texts in an order that doesn't depend on how they came."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _answers(requests: DataFrame, buckets: int) -> DataFrame:
    """For each request the training counts over all blocks, in its order; and its bucket's share of the training tokens and distinct words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            counts = [_widen(c, w + n) for _, w, n, *_, c in held]
            words, of_words = _summed([_got(k, w) for _, w, _, k, *_ in held], [c[:w] for (_, w, *_), c in zip(held, counts)])
            _, of_longer = _summed([_got(k, n) for _, _, n, _, k, _ in held], [c[w:] for (_, w, *_), c in zip(held, counts)])
            total, kinds = int(words.sum()), int((words > 0).sum())
            for (block, *_), *both in zip(held, of_words, of_longer):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at], pa.int32()), pa.array([_narrow(np.concatenate(both))], pa.binary()), pa.array([total]), pa.array([kinds])], ["block", "bucket", "counts", "total", "kinds"])
            held.clear()

        for batch in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and held:
                    yield from done()
                at = bucket
                held.append(tuple(rest))
        if held:
            yield from done()

    return requests.repartition(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(add, ANSWERS)


class Automaton:
    """The part of the model that a block's texts can reach, as arrays over its n-grams: whether there is an arc, the arc's weight, and the failure weight of the state that an n-gram is as a context. The last entry, which -1 finds, is that of no n-gram: a block of short texts may have none."""

    def __init__(self, block: Block, counts: np.ndarray, total: int, kinds: int) -> None:
        self.block, self.order = block, len(block.levels)
        self.counts = np.split(counts, np.cumsum([len(level.keys) for level in block.levels])[:-1])
        self.arc, self.weight, self.failure = [], [], []
        shorter = (self.counts[0] + ADD) / (total + ADD * (kinds + 1))
        for n, level in enumerate(block.levels, 1):
            c = self.counts[n - 1]
            if n == 1:
                p = shorter
            else:
                last = np.full(len(level.keys), -1)  # a token at which each n-gram ends
                has = np.flatnonzero(level.ends >= 0)
                last[level.ends[has]] = has
                before = self.counts[n - 2][block.levels[n - 2].ends[last - 1]]
                p = (c + SHORTER * shorter[block.levels[n - 2].ends[last]]) / (before + SHORTER)
            self.arc.append(np.append(c > 0 if n > 1 else np.ones(len(c), bool), False))
            self.weight.append(np.append(np.log10(p), 0.0))
            self.failure.append(np.append(np.log10(SHORTER / (c + SHORTER)), 0.0))
            shorter = p

    def score(self, a: int, z: int) -> float:
        """log10 probability of the tokens a to z, one text's. The state is the n-gram of length k that ends before a token."""
        levels = self.block.levels
        at = [level.ends[a:z] for level in levels]
        arc = [self.arc[n][at[n]].tolist() for n in range(self.order)]
        weight = [self.weight[n][at[n]].tolist() for n in range(self.order)]
        failure = [self.failure[n][at[n]].tolist() for n in range(self.order - 1)]
        score, k = 0.0, 0
        for i in range(z - a):
            while k and not arc[k][i]:
                k -= 1
                score += failure[k][i - 1]
            score += weight[k][i]
            k = min(k + 1, self.order - 1)
        return score


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row; the model learns from the rows where training holds.

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, and an end. base_score is the log10 probability by single words,
    score that of the automaton. Null and empty texts are just an end; null ids keep null and, where training is null, aren't learned
    from; repeated rows count and are scored each; without training rows N and V are 0; other columns are ignored.

    Texts are shuffled once, by block; a second use of that exchange is shared. A lost executor's blocks are built again from it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = shuffles(spark)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("trained"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * buckets, -(-size // BLOCK_BYTES))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(blocks)).cast("int"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        table = _in_order(table)
        block = Block(blobs(table.column("text").combine_chunks()), table.column("trained").to_numpy(), order, buckets)
        counts = np.concatenate([level.trained for level in block.levels])
        rows = []
        for k in range(buckets):  # empty ones, too: the answer brings the bucket's totals
            part, words = block.part(k)
            within = block.within[part]
            rows.append((k, key[0].as_py(), words, len(part) - words, _sent(within[:words]), _sent(within[words:]), _narrow(counts[part])))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in REQUESTS.split(", ")])

    answers = _answers(dealt.groupBy("block").applyInArrow(ask, REQUESTS), buckets)

    def walk(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        table = _in_order(table)
        trained = table.column("trained").to_numpy()
        block = Block(blobs(table.column("text").combine_chunks()), trained, order, buckets)
        counts = np.zeros(len(block.by), np.int64)
        for bucket, data in zip(got.column("bucket").to_pylist(), got.column("counts").to_pylist()):
            part, _ = block.part(bucket)
            counts[part] = _widen(data, len(part))
        total, kinds = sum(got.column("total").to_pylist()), sum(got.column("kinds").to_pylist())
        machine = Automaton(block, counts, total, kinds)
        base, known = machine.weight[0][block.levels[0].ends], machine.counts[0][block.levels[0].ends] > 0
        spans = list(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()))
        columns = [pa.array([z - a for a, z in spans], pa.int64()), pa.array([int(known[a:z].sum()) for a, z in spans], pa.int64()), pa.array([total] * len(spans), pa.int64()), pa.array([float(base[a:z].sum()) for a, z in spans]), pa.array([machine.score(a, z) for a, z in spans])]
        return pa.table([table.column("doc_id"), table.column("trained"), *columns], ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored
