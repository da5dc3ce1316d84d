"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from prismora.llm import decontaminate, substrings
from prismora.llm.common import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = tokens((text or "").encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, shared passages, a benchmark passage, nulls, empty texts, repeated rows and junk, and their labels."""
    rng, out = random.Random(31), tmp_path_factory.mktemp("pipeline")
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    prose = lambda n: [word() for _ in range(n)]
    item, passage = prose(40), prose(70)
    rows = [(k, " ".join(prose(rng.randint(60, 160)))) for k in range(60)]
    rows += [(60 + k, rows[k][1]) for k in range(5)] + [(70 + k, " ".join([*rows[10 + k][1].split()[:-1], "edited"])) for k in range(5)]
    rows += [(80 + k, " ".join([*prose(30), *passage, *prose(30)])) for k in range(4)]
    rows += [(90, " ".join([*prose(20), *item, *prose(20)])), (91, None), (92, ""), (93, "short"), (94, rows[3][1]), (94, rows[3][1]), (None, " ".join(prose(80)))]
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = rows_of(docs)
    assert collections.Counter(rows_of(stages["quality_classifier"](spark, docs, folder))) == collections.Counter(before)  # every label is 1

    sets = [(i, shingles(t)) for i, t, *_ in before if i is not None]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in sets:
        for j, y in sets:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    kept = [r for r in before if r[0] is None or find(r[0]) == r[0]]
    unique = stages["ngram_jaccard_join"](spark, docs, folder)
    assert collections.Counter(rows_of(unique)) == collections.Counter(kept) and len(kept) < len(before) - 10

    cut = {r[0]: r for r in rows_of(stages["substring_dedup"](spark, unique, folder))}
    seq = {i: substrings.sequence((t or "").encode()) for i, t, *_ in kept if i is not None}
    gone = collections.defaultdict(set)
    for b in seq:
        for a in seq:
            if a < b and len(seq[b]) and len(seq[a]):
                for s, e, *_ in substrings.passages(seq[b], seq[a], 46, 75):
                    gone[b].update(range(s, e + 4))
    assert set(gone) == {81, 82, 83}
    for r in kept:
        if r[0] in gone:
            words = [w for k, w in enumerate(r[1].split()) if k not in gone[r[0]]]
            assert cut[r[0]][1].split() == words and cut[r[0]][4] == len(cut[r[0]][1])
        else:
            assert cut[r[0]] == r

    left = rows_of(stages["benchmark_decontamination"](spark, unique, folder))
    (item,) = (r.text.split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect())
    word = collections.defaultdict(lambda: len(word))
    coded = lambda ws: np.array([word[w] for w in ws], np.int64)
    leaks = {r[0] for r in kept if r[1] and decontaminate.align(coded(item), coded(r[1].split()))[0] >= len(item)}
    assert leaks == {90} and collections.Counter(left) == collections.Counter(r for r in kept if r[0] not in leaks)


def test_run_packs_what_the_stages_keep(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    library = corpus_pipeline.packing.pretokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, *_ in rows_of(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert len(ids) <= 2048
        want[i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = rows_of(corpus_pipeline.run(spark, folder))
    assert collections.Counter(r[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r[5]].append((r[6], r[3]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
