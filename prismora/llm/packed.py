"""An exchange of many small keyed entries as few packed rows.

A mapper gathers (key, owner) entries and sends, for each bucket of keys, one row of sorted entries and the owners that these
name; a reducer sees all entries of a bucket at once as numpy arrays. That is several times smaller than a row for
each entry. The number of buckets is chosen from the number of entries (buckets_for), so a bucket's size doesn't grow with the input, but
for the entries of one key, which meet in one bucket. Keys keep 32 bits or fewer within their bucket: entries of different keys may rarely
meet, and callers verify.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, shuffles

#: Entries and owners that a mapper gathers before it sends them on, and entries of a bucket.
ENTRIES, OWNERS, BUCKET = 1_500_000, 60_000, 2_000_000
#: Bits of an owner's place in a filling.
_PLACE = 16
SCHEMA, RECORDS = "bucket int, n int, gaps binary, owners binary, ids binary", "part int, records binary"


def buckets_for(spark: SparkSession, entries: int) -> int:
    """As many buckets as shuffles have partitions, more where the entries are too many for those."""
    return max(shuffles(spark), -(-entries // BUCKET))


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T[:width]).tobytes()


def _unplane(data: bytes, n: int) -> np.ndarray:
    """The numbers of n entries, whatever their width."""
    width = len(data) // n
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u4").ravel()


class Packer:
    """Gathers the keys of owners; full() tells when to take rows(). An owner is a record of a fixed dtype (a 64-bit id, by default) that goes along once for each bucket and filling that names it."""

    def __init__(self, buckets: int, kind: np.dtype | type = np.int64, bits: int = 32) -> None:
        self.buckets, self.kind, self.keys, self.ids, self.n = buckets, kind, [], [], 0
        self.bits = np.uint64(min(bits, 64 - _PLACE - max(buckets - 1, 1).bit_length()))

    def add(self, owner: int | tuple, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.ids.append(owner)
        self.n += len(keys)

    def full(self) -> bool:
        return self.n >= ENTRIES or len(self.ids) >= OWNERS

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(entries, owners): bucket, key and place of the owner in one number each, sorted."""
        b = np.uint64(self.buckets)
        keys = np.concatenate(self.keys)
        entries = keys % b << self.bits
        keys //= b
        keys &= (np.uint64(1) << self.bits) - np.uint64(1)
        entries |= keys
        entries <<= np.uint64(_PLACE)
        entries |= np.repeat(np.arange(len(self.ids), dtype=np.uint64), [len(k) for k in self.keys])
        entries.sort()
        ids = np.array(self.ids, self.kind)
        self.keys, self.ids, self.n = [], [], 0
        return entries, ids

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from self.pack(*self.take())

    def pack(self, entries: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        shift = self.bits + np.uint64(_PLACE)
        bounds = np.searchsorted(entries, np.arange(self.buckets, dtype=np.uint64) << shift)
        bounds = np.append(bounds, len(entries))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = entries[bounds[k] : bounds[k + 1]]
            low = (part >> np.uint64(_PLACE) & ((np.uint64(1) << self.bits) - np.uint64(1))).astype("<u4")
            place = (part & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
            named = np.zeros(len(ids), bool)
            named[place] = True
            gaps = np.diff(low, prepend=np.uint32(0))
            own = (np.cumsum(named) - 1)[place].astype("<u2")
            width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
            columns = [k], [len(part)], [_planes(gaps, width)], [_planes(own, 1 if len(ids) <= 256 else 2)], [ids[named].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "n", "gaps", "owners", "ids"])


def reduce_buckets(packed: DataFrame, buckets: int, reducer: Callable[..., Iterator[pa.RecordBatch]], schema: str, kind: np.dtype | type = np.int64, aside: Callable[[bytes, bytes], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Calls reducer(keys, owner, records), sorted by key and then owner, for each bucket; yields what it yields. records are the owners, sorted (by their field id, if they have fields), and owner has the place of each entry's owner among them. Rows that a mapper marked by n = -1 go to aside(gaps, ids)."""
    plain = np.dtype(kind).names is None

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            records = np.concatenate([np.frombuffer(ids, kind) for *_, ids in held])
            start = np.cumsum([0, *(len(ids) // np.dtype(kind).itemsize for *_, ids in held)])
            _, one, which = np.unique(records if plain else records["id"], return_index=True, return_inverse=True)
            entries = np.empty(sum(n for n, *_ in held), np.uint64)
            z = 0
            for k, (n, gaps, owners, _) in enumerate(held):
                keys = np.cumsum(_unplane(gaps, n), dtype=np.uint64)
                entries[z : z + n] = keys << np.uint64(32) | which[_unplane(owners, n) + start[k]].astype(np.uint64)
                z += n
            held.clear()
            entries.sort()
            new = np.ones(len(entries), bool)
            new[1:] = entries[1:] != entries[:-1]
            entries = entries[new]
            yield from reducer((entries >> np.uint64(32)).astype(np.uint32), (entries & np.uint64(0xFFFFFFFF)).astype(np.int64), records[one])

        for batch in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and held:
                    yield from done()
                at = bucket
                if rest[0] < 0:
                    yield from aside(rest[1], rest[3])
                else:
                    held.append(tuple(rest))
        if held:
            yield from done()

    return packed.repartition(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, schema)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def dealt(table: np.ndarray, part: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The records of a table of a fixed dtype, as one packed row for each part."""
    by = np.argsort(part, kind="stable")
    table, bounds = table[by], np.searchsorted(part[by], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(bounds)).tolist()
    if full:
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([table[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary())], ["part", "records"])


def reduce_parts(packed: DataFrame, parts: int, kind: np.dtype, reducer: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls reducer(table) with all records of each part of rows from dealt()."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None
        for batch in batches:
            for part, records in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at and held:
                    yield from reducer(np.frombuffer(b"".join(held), kind))
                    held.clear()
                at = part
                held.append(records)
        if held:
            yield from reducer(np.frombuffer(b"".join(held), kind))

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)
