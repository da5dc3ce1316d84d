"""Token counts by a two-tier lookup on the map side; pre-tokens are never shuffled."""

from __future__ import annotations

import collections
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import pretokens
from .common import bounded_batches, in_slices, releasing

#: About how many rows have their pre-tokens counted for the first tier, and pre-tokens in it.
SAMPLE_ROWS, FREQUENT = 2_000, 50_000

_lookups: dict[tuple[str, int], pretokens.Lengths] = {}


def frequent_lengths(texts: DataFrame, tokenizer_path: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> dict[str, int]:
    """The token counts of the most frequent pre-tokens, at most `most`, of about `rows` whole texts, drawn evenly with a fixed seed. The sample
    decides only what is looked up quickly. One task counts it, so no pre-token is shuffled."""

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: collections.Counter[str] = collections.Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(t for t in pretokens.pre_tokens(text, tokenizer_path) if len(t) <= pretokens.LONG)
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string())], ["pre_token"])

    share = min(1.0, rows / max(1, texts.count()))
    sample = texts.where("text is not null").select("text").sample(share, 1).repartition(1)
    return pretokens.lengths_of([r.pre_token for r in sample.mapInArrow(count, "pre_token string").collect()], tokenizer_path)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: the number of tokens the tokenizer gives its whole text, and whether it is over limit.

    The first tier, a broadcast table of the lengths of frequent pre-tokens, has FREQUENT rows at most, however large the corpus;
    a worker's own cache, bounded in bytes, answers the rest and asks the tokenizer for what it lacks.
    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows stay as they are; other
    columns are ignored; an empty table gives no rows; a text of any length is held by one task. One narrow stage: a lost executor's rows are counted again from the input.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_lengths(picked, tokenizer_path))
    key = (tokenizer_path, id(frequent))

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lookups.get(key)
        if lengths is None:
            _lookups.clear()
            lengths = _lookups[key] = pretokens.Lengths(tokenizer_path, frequent.value)
        get = lengths.__getitem__
        for batch in in_slices(batches):
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = [sum(map(get, pretokens.pre_tokens(t, tokenizer_path))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return picked.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
