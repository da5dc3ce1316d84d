"""An exact n-gram Jaccard self-join by PartEnum signatures.

Two sets of a size band whose symmetric difference is at most k share a signature: the feature domain is
dealt into n1 partitions, of which enough differ in at most k2 features, and each of those into n2 cells, of which all but
k2 agree. A signature is a partition and all but k2 of its cells with their content. Sets that share one are compared with one of
them, the pivot, and then with those of the pivot's other sets that are still in another component.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTERED, blobs, bounded_batches, cut, distinct, grams, in_slices, mix, releasing, settings, shared_dir, shuffles, tokens, word_hashes
from .components import components
from .packed import RECORDS, SCHEMA, Packer, buckets_for, dealt, reduce_buckets, reduce_parts, runs

#: Cells of the counts whose distance bounds that of two sets from below; counts stop at 255.
FINE = 512
#: Members of the blocks in which a pivot's members are compared.
BLOCK = 1024
#: What travels with a set's signatures: the one of the least rank is its group's pivot.
OWNER = np.dtype([("id", np.int64), ("rank", np.uint32)])
PAIR = np.dtype([("a", np.int64), ("b", np.int64)])
COUNTED = np.dtype([("high", np.int64), ("shared", np.int32), ("own", np.bool_)])
#: What stands for all owners of a shingle that a mapper has found twice; the ids of sets are even.
MANY = 1


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    return distinct(grams(word_hashes(tokens(text)), words))


def set_key(own: np.ndarray) -> tuple[int, int]:
    """An id of a whole set, in two numbers of 64 bits: equal sets have equal ids. The first is even."""
    sums = [mix(own ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x5DEECE66D, 0xA24BAED4963EE407)]
    high, low = mix(np.array(sums, np.uint64) + np.uint64(len(own))).view(np.int64).tolist()
    return high & ~1, low


def bands(percent: int, most: int) -> list[int]:
    """First sizes of the bands: sets that can link are in the same band or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return [*out, out[-1] * 100 // percent + 1, (out[-1] * 100 // percent + 1) * 100 // percent + 1]


@functools.lru_cache(maxsize=1024)
def partitions(low: int, high: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, k2, n2, good): partitions, the features in which one may differ, its cells, and how many partitions of a pair differ in no more.

    The smaller set of a pair has low to high shingles, which bounds the size of a linking pair's difference by k. A
    small k is taken by one partition, a larger one by about k / 2 of them with 4 cells.
    """
    k = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
    if k <= 4:
        return 1, k, k + 3 if k else 1, 1
    bad = k // 2
    n1 = bad + 1
    while 100 * (n1 - bad) < 100 + 15 * n1:
        n1 += 1
    return n1, 1, 4, n1 - bad


def signatures(own: np.ndarray, first: list[int], percent: int) -> np.ndarray:
    """The signatures of a set in the instances of its band and of the one below, where it is the smaller or the larger set of a pair.

    A signature is a partition, all but k2 of its cells, and what they hold. Cells without any shingle would be shared by everything
    sparse. A set leaves such signatures out if fewer than `good` partitions have all their shingles in k2 cells: then of those in
    which a pair differs in no more than k2 features one has another cell with a shingle, and that cell is equal in both. A
    set with more sends all.
    """
    band = int(np.searchsorted(first, len(own), "right")) - 1
    out = []
    for instance in range(max(0, band - 1), band + 1):
        n1, k2, n2, good = partitions(first[instance], first[instance + 1] - 1, percent)
        salted = mix(own + np.uint64((instance + 1) * 0x9E3779B97F4A7C15 % 2**64))
        cell = (salted % np.uint64(n1 * n2)).astype(np.int64)
        content = np.zeros(n1 * n2, np.uint64)
        np.add.at(content, cell, mix(salted + np.uint64(1)))
        content = mix(content.reshape(n1, n2) + mix(np.arange(1, n2 + 1, dtype=np.uint64)))
        size = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        without = np.array(list(itertools.combinations(range(n2), k2)), np.int64).reshape(math.comb(n2, k2), k2)
        codes = content.sum(axis=1)[:, None] - content[:, without].sum(axis=2)
        empty = size.sum(axis=1)[:, None] == size[:, without].sum(axis=2)
        tags = mix(np.arange(codes.size, dtype=np.uint64) + np.uint64(instance << 32))
        codes = mix(codes.ravel() + tags)
        thin = int(((size > 0).sum(axis=1) <= k2).sum())
        out.append(codes[~empty.ravel()] if thin < good else codes)
    return np.concatenate(out)


def _of_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, high, low) of every row."""

    @releasing
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [shingles(t, words) for t in blobs(batch.column(1))]
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[x] for k in keys], pa.int64()) for x in (0, 1))], ["doc_id", "n_shingles", "high", "low"])

    return docs.mapInArrow(measure, "doc_id long, n_shingles long, high long, low long")


def _shared_counts(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """(high, shared): at least how many of a set's shingles another set has, too, found where shingles meet; where hashes meet it is too large.

    A mapper counts shingles that several of its own sets have and sends one entry for all of them, so a shingle of a third of all
    documents is an entry a filling. A set that several mappers have takes the least of their counts, as buckets count what any of them sent.
    A bucket tells of a set when a quarter of the set's entries there are shared: if q of n are, the other buckets hold at most (n - q) * 4 / 3 entries, of which a
    quarter are shared; so shared is at least q - (n - q) / 3. Sets that share a line or two send next to nothing.
    """

    @releasing
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(buckets, bits=27), set()

        def rows() -> Iterator[pa.RecordBatch]:
            if not packer.n:
                return
            entries, ids = packer.take()
            at, n = runs(entries >> np.uint64(16))
            several = np.repeat(n > 1, n)
            place = (entries & np.uint64(0xFFFF)).astype(np.int64)
            own = np.bincount(place[several], minlength=len(ids))
            many = at[n > 1]
            entries[many] = entries[many] & ~np.uint64(0xFFFF) | np.uint64(len(ids))
            several[many] = False
            yield from packer.pack(entries[~several], np.append(ids, np.int64(MANY)))
            bucket = int(own.sum()) % buckets
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([-1], pa.int32()), pa.array([own.astype("<i4").tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([ids.tobytes()], pa.binary())], ["bucket", "n", "gaps", "owners", "ids"])

        for batch in in_slices(batches):
            for text in blobs(batch.column(1)):
                own = shingles(text, words)
                if len(own) and (key := set_key(own)[0]) not in seen:
                    seen.add(key)
                    packer.add(key, own)
                    if packer.full():
                        yield from rows()
        yield from rows()

    def count(keys: np.ndarray, owner: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, n = runs(keys)
        every, shared = np.bincount(owner, minlength=len(sets)), np.bincount(owner[np.repeat(n > 1, n)], minlength=len(sets))
        keep = (4 * shared >= every) & (sets != MANY) & (shared > 0)
        yield from told_of(sets[keep], shared[keep], False)

    def aside(gaps: bytes, ids: bytes) -> Iterator[pa.RecordBatch]:
        yield from told_of(np.frombuffer(ids, np.int64), np.frombuffer(gaps, "<i4"), True)

    def told_of(sets: np.ndarray, shared: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        table = np.empty(len(sets), COUNTED)
        table["high"], table["shared"], table["own"] = sets, shared, own
        yield from dealt(table, (mix(sets.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)

    def summed(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets, which = np.unique(table["high"], return_inverse=True)
        met, least, own = np.zeros(len(sets), np.int64), np.full(len(sets), 2**62), table["own"]
        np.add.at(met, which[~own], table["shared"][~own])
        np.minimum.at(least, which[own], table["shared"][own])
        yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(met + least)], ["high", "shared"])

    counted = reduce_buckets(docs.mapInArrow(send, SCHEMA), buckets, count, RECORDS, aside=aside)
    return reduce_parts(counted, buckets, COUNTED, summed, "high long, shared long")


def _fetch(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, n, rank, shingles, sketch) of each wanted (set_id, high, low, rank): read anew from the text of the document set_id."""
    joined = docs.join(wanted, docs["doc_id"] == wanted["set_id"]).select("set_id", "high", "low", "rank", "text")

    @releasing
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 128):
            keys, sets, seen, ranks = [], [], [], []
            for key, high, low, rank, text in zip(*(c.to_pylist() for c in batch.columns[:4]), blobs(batch.column(4))):
                own = shingles(text, words)
                if len(own) and set_key(own) == (high, low):  # else another row of the same doc_id
                    keys.append(key)
                    ranks.append(rank)
                    sets.append(own.view(np.int64))
                    seen.append(np.minimum(np.bincount((mix(own) % np.uint64(FINE)).astype(np.int64), minlength=FINE), 255).astype(np.uint8).tobytes())
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ranks, pa.int64()), flat, pa.array(seen, pa.binary())], ["set_id", "n", "rank", "shingles", "sketch"])

    return joined.mapInArrow(measure, "set_id long, n long, rank long, shingles array<long>, sketch binary")


def _stars(sets: DataFrame, first: list[int], percent: int, buckets: int) -> DataFrame:
    """(a, b): for every group of sets that share a signature, each member a with the group's pivot b, the member of the least rank.

    Ranks hold for all groups alike, so a set meets few pivots however many signatures it has: n sets that are near copies give about n pairs.
    A pair that several buckets find goes from each to the task of its a, packed, and is a row only there.
    """

    @releasing
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, OWNER)
        for batch in in_slices(batches):
            for key, rank, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                packer.add((key, rank), signatures(np.asarray(own.values).view(np.uint64), first, percent))
                if packer.full():
                    yield from packer.rows()
        yield from packer.rows()

    def meet(keys: np.ndarray, owner: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, n = runs(keys)
        keep = np.repeat(n > 1, n)
        owner, n = owner[keep], n[n > 1]
        if not len(n):
            return
        place = np.empty(len(records), np.int64)
        place[np.lexsort((records["id"], records["rank"]))] = np.arange(len(records))
        owner = place[owner]
        pivot = np.repeat(np.minimum.reduceat(owner, np.append(0, np.cumsum(n)[:-1])), n)
        code = distinct((owner << 32 | pivot)[owner != pivot])
        ids = np.empty(len(records), np.int64)
        ids[place] = records["id"]
        table = np.empty(len(code), PAIR)
        table["a"], table["b"] = ids[code >> 32], ids[code & 0xFFFFFFFF]
        yield from dealt(table, (mix(table["a"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)

    def once(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table[np.lexsort((table["b"], table["a"]))]
        new = np.ones(len(table), bool)
        new[1:] = table[1:] != table[:-1]
        table = table[new]
        for k in range(0, len(table), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[c][k : k + 100_000])) for c in ("a", "b")], ["a", "b"])

    packed = sets.select("set_id", "rank", "shingles").mapInArrow(send, SCHEMA)
    met = reduce_buckets(packed, buckets, meet, RECORDS, OWNER)
    return reduce_parts(met, buckets, PAIR, once, "a long, b long")


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with columns of both sets. The sets lie in buckets by set_id, so only the pairs move; those of one set that is in many are split by Spark's skew join."""
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set_id").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in columns)), c)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Fine counts, a tenth of the shingles' bytes, go first and leave few other pairs."""
    both = _with_sets(pairs, sets, "n", "sketch").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    @releasing
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, FINE) for k in (2, 3))
            apart = np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64)
            keep = pa.array(apart * (100 + percent) <= batch.column(4).to_numpy() * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    near = cut(both.select("a", "b", "sketch_a", "sketch_b", F.col("n_a") + F.col("n_b")).mapInArrow(compare, "a long, b long"), "near")
    counted = _with_sets(near, sets, "n", "shingles").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long").alias("common"))
    return counted.where(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b")


def _bucketed(df: DataFrame) -> tuple[DataFrame, str]:
    """df, one row for each set_id, as a table in as many buckets by set_id as shuffles have partitions, in the shared folder; and its name."""
    spark, name = df.sparkSession, f"prismora_sets_{uuid.uuid4().hex}"
    n = shuffles(spark)
    df.repartition(n, "set_id").dropDuplicates(["set_id"]).write.bucketBy(n, "set_id").sortBy("set_id").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def _across(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one pivot's members that are in different components and may link, by their sizes and the distance of their counts.

    Of such a pair one member at least is outside the pivot's most common component. Those are compared with all the others in blocks of
    BLOCK by BLOCK members, each a task's unit of work that holds no more than those.
    """
    of = labels.select(F.col("id").alias("a"), "label")
    members = cut(stars.join(of, "a", "left").select(F.col("b").alias("pivot"), F.col("a").alias("set_id"), F.coalesce("label", "a").alias("label")), "members")
    each = members.groupBy("pivot", "label").agg(F.count("*").alias("n"))
    size = each.groupBy("pivot").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("most")).where("kinds > 1")
    width = size.select("pivot", "top", F.ceil(F.col("n") / BLOCK).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("high"))
    own = members.join(width, "pivot").join(sets.select("set_id", "n", "sketch"), "set_id").withColumn("loose", F.col("label") != F.col("top"))
    at = lambda c: F.pmod(F.xxhash64("set_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    names = ("pivot", "x", "y", "left", "loose", "set_id", "label", "n", "sketch")
    left = own.where("loose").withColumn("left", F.lit(True)).withColumn("x", at("high")).withColumn("y", every("wide")).select(*names)
    right = own.withColumn("left", F.lit(False)).withColumn("y", at("wide")).withColumn("x", every("high")).select(*names)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, label, n, loose, is_left = (table.column(c).to_numpy() for c in ("set_id", "label", "n", "loose", "left"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, FINE).astype(np.int16)
        found = [np.zeros((2, 0), np.int64)]
        others = np.flatnonzero(~is_left)
        others = others[np.argsort(n[others], kind="stable")]
        sizes = n[others]
        for i in np.flatnonzero(is_left).tolist():
            j = others[np.searchsorted(100 * sizes, percent * n[i]) : np.searchsorted(percent * sizes, 100 * n[i], "right")]
            j = j[(label[j] != label[i]) & (~loose[j] | (ids[j] > ids[i]))]
            for k in range(0, len(j), 256):
                part = j[k : k + 256]
                apart = np.abs(sketch[part] - sketch[i]).sum(axis=1, dtype=np.int64)
                part = part[apart * (100 + percent) <= (n[i] + n[part]) * (100 - percent)]
                found.append(np.stack([np.full(len(part), ids[i]), ids[part]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return left.unionByName(right).groupBy("pivot", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; exact, up to shingles and sets whose hashes (64 and 127 bits) are equal.

    A document's set is its distinct shingles of `words` words; with fewer words, the whole sequence; with none, it is
    empty (null and empty texts), linked with nothing, and its own component. Two documents link when
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable. Rows with equal ids are
    placed each by its own text; a row with a null id keeps a null component and links nothing. Other columns are ignored. An
    empty table gives no rows; a text of any length is one set, held by one task.

    Steps, each written to the shared folder: equal sets become one; sets of which too few shingles occur in
    another set can't link and go (a necessary condition); the others get PartEnum signatures. Each set that shares a signature is
    verified against the group's pivot. Two sets that link either are a pivot and its member, or are members of one pivot: of the pivots
    whose members then are in several components, those pairs are compared that are not in one, by their counts and then as sets.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = cut(_of_sets(own, words), "sets")
    reps = rows.where("high is not null and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("set_id"), F.max("n_shingles").alias("n"))
    reps = cut(reps, "reps")
    shared = _shared_counts(own.where("doc_id is not null"), words, buckets_for(spark, rows.agg(F.sum("n_shingles")).first()[0] or 0))
    enough = f"300 * shared >= {4 * percent - 100} * n"  # q >= percent / 100 * n in q - (n - q) / 3
    rank = F.floor(F.greatest(F.col("n") - F.col("shared"), F.lit(0)) * 15 / F.col("n")) * (1 << 28) + F.shiftrightunsigned(F.xxhash64("set_id"), 36)
    wanted = cut(reps.join(shared, "high").where(enough).select("set_id", "high", "low", "n", rank.alias("rank")), "wanted")
    with settings(spark, FILTERED):
        sets, table = _bucketed(_fetch(own, wanted.where("n > 0").select("set_id", "high", "low", "rank"), words))
    most, entries = wanted.agg(F.max("n"), F.sum("n")).first()
    stars = cut(_stars(sets, bands(percent, most or 1), percent, buckets_for(spark, 2 * (entries or 0))), "stars")
    links = cut(_verified(stars, sets, percent), "links")
    labels = components(links)
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = cut(_across(stars, labels, sets, percent).join(tried, ["a", "b"], "left_anti"), "across")
    more = cut(_verified(across, sets, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    spark.sql(f"DROP TABLE {table}")  # its files stay with the other cut points
    placed = cut(reps.join(labels.select(F.col("id").alias("set_id"), "label"), "set_id", "left").select("high", "low", F.coalesce("label", "set_id").alias("label")), "placed")
    joined = rows.join(placed, ["high", "low"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
