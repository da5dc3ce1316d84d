"""The edit log: newest wins, generations, stale results, undo history, and the same as a stream."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States that an undo history keeps.
KEPT = 100


def edits(events: DataFrame) -> DataFrame:
    """(source, ts, seq, action, value): events as edits of a source, values as a slider in -2..2."""
    return events.select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("action"), (F.rint((F.col("value") % 4 - 2) * 10000) / 10000).alias("value"))


def newest(log: DataFrame) -> DataFrame:
    """(source, seq, action, value): the last edit of each source by (ts, seq). A partial aggregate leaves one row for each source and task."""
    last = log.groupBy("source").agg(F.max_by(F.struct("seq", "action", "value"), F.struct("ts", "seq")).alias("e"))
    return last.select("source", "e.*")


def generations(log: DataFrame) -> DataFrame:
    """Adds generation: 1 more whenever a source's mode changes, and after each error, which invalidates."""
    w = Window.partitionBy("source").orderBy("ts", "seq")
    mode = F.when(F.col("action").isin("view", "click"), "view").otherwise("detail")
    before = F.lag("mode").over(w)
    return log.withColumn("mode", mode).withColumn("changed", F.when(before.isNull() | (before != F.col("mode")) | (F.lag("action").over(w) == "error"), 1).otherwise(0)).withColumn("generation", F.sum("changed").over(w)).drop("changed")


def stale(log: DataFrame) -> DataFrame:
    """Adds published: a frame that is finished when the next edit comes is shown only if the generation is still its own."""
    w = Window.partitionBy("source").orderBy("ts", "seq")
    return generations(log).withColumn("published", F.coalesce(F.lead("generation").over(w) == F.col("generation"), F.lit(True)))


def histories(log: DataFrame, kept: int = KEPT) -> DataFrame:
    """(source, states, at, value): each source's undo history after its log. click undoes, view redoes, everything else commits its value; a repeated value is no edit, a commit after undo drops what could be redone."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        states, at = [0.0], 0
        for action, value in rows.sort_values(["ts", "seq"])[["action", "value"]].itertuples(index=False):
            if action == "click":
                at = max(0, at - 1)
            elif action == "view":
                at = min(len(states) - 1, at + 1)
            elif value != states[at]:
                states = [*states[: at + 1], value][-kept:]
                at = len(states) - 1
        return pd.DataFrame({"source": [key[0]], "states": [len(states)], "at": [at], "value": [states[at]]})

    return log.groupBy("source").applyInPandas(fold, "source long, states int, at int, value double")


def newest_stream(log: DataFrame) -> DataFrame:
    """The streaming form of newest: one state a source, the newest edit so far; emits it whenever a batch brings a newer one. Order is that of (ts, seq), so late files do no harm."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for rows in batches:
            for row in rows[["ts", "seq", "action", "value"]].itertuples(index=False):
                found = (int(row.ts.value), int(row.seq), row.action, float(row.value))
                if best is None or found[:2] > best[:2]:
                    best = found
        state.update(best)
        if best != before:
            yield pd.DataFrame({"source": [key[0]], "ts": [best[0]], "seq": [best[1]], "action": [best[2]], "value": [best[3]]})

    return log.groupBy("source").applyInPandasWithState(keep, "source long, ts long, seq long, action string, value double", "ts long, seq long, action string, value double", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Runs newest_stream over a Parquet folder's files with availableNow and returns its last word on each source.

    What the stream says goes to Parquet files in the folder that driver and executors share (spark.checkpoint.dir; a temporary one where that is unset), and so does its checkpoint: nothing gathers in the driver.
    """
    schema = spark.read.parquet(path).schema
    folder, _, pattern = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="prismora-")
    out = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    said = newest_stream(edits(source))
    said.writeStream.format("parquet").option("path", f"{out}/said").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    last: Column = F.max_by(F.struct("seq", "action", "value"), F.struct("ts", "seq"))
    return spark.read.schema(said.schema).parquet(f"{out}/said").groupBy("source").agg(last.alias("e")).select("source", "e.*")
