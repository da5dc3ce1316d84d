"""A corpus pipeline of the operators in prismora.llm: stages of (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of the documents they get. A row stands for itself: rows with a null id
pass the filters that go by id, and repeated rows share their id's fate. Null and empty texts are kept and packed as an end each; a text of
any length is one document; of equal candidates the smallest doc_id stays; an empty table gives no rows; columns of other names stay as they are, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismora.llm import decontaminate, jaccard, packing, quality, substrings
from prismora.llm.common import id_crc, shared_dir
from prismora.llm.queries import TOKENIZER


def _unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs has."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in the first column of ids."""
    gone = _unused(docs, "gone")
    ids = ids.select(ids[ids.columns[0]].alias(gone)).distinct()
    return docs.join(ids, docs["doc_id"] == ids[gone], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs, labels, id_crc(F.col("doc_id")) % 3 != 1)
    return _without(docs, scored.where("score < 0.5").select("doc_id"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of the smallest doc_id stays."""
    found = jaccard.jaccard_components(docs)
    return _without(docs, found.where("component_id <> doc_id").select("doc_id"))


def _of_text() -> Column:
    """A number that tells a text from what is left of it, null for null: it moves in the text's place."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the later ones, whose n_chars follows; a document that keeps no word goes."""
    found = substrings.near_duplicate_passages(docs)
    before = _unused(docs, "before")
    left = substrings.cut_passages(docs.withColumn(before, _of_text()), found)
    left = left.where(F.col("text").isNotNull() | F.col(before).isNull())
    if "n_chars" in docs.columns:
        same = _of_text().eqNullSafe(F.col(before))
        left = left.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, leaks.select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_classifier", quality_stage), ("ngram_jaccard_join", near_duplicates_stage), ("substring_dedup", substrings_stage), ("benchmark_decontamination", decontamination_stage), ("best_fit_packing", packing_stage)]

#: SQL can't express the stages: boosted trees, alignments, and the tokens of a BPE model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
