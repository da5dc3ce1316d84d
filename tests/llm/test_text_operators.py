"""Each operator against a brute-force version, with nulls, empty and repeated rows, and clashing columns."""

from __future__ import annotations

import collections
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prismora.llm import decontaminate, jaccard, lm, packing, pretokens, quality, substrings, token_counts
from prismora.llm.common import id_crc, tokens
from prismora.llm.components import components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "on", "ur")]
ODD = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, " \n\t"), (None, "one two"), (6, "x"), (6, "x"), (7, "é ß <|endoftext|> 'tis 12 \x1c 中文")]
SCHEMA = "doc_id long, text string, n_tokens string, block int, score double"


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def frame(spark, rows):
    """With columns whose names the operators use within."""
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = list(ODD)
    for k in range(40):
        rows.append((100 + k, " ".join(prose(rng, rng.choice([6, 30, 80, 200])))))
    for k, base in enumerate(rng.sample(rows[len(ODD) :], 25)):
        w = base[1].split()
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = "zz"
        rows.append((200 + k, " ".join(w)))
    big = prose(rng, 60)
    for k in range(50):  # a group of near copies that is larger than SMALL, drifting apart
        big[rng.randrange(60)] = f"new{k}"
        rows.append((300 + k, " ".join(big)))
    return rows


def shingles(text):
    w = tokens((text or "").encode())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_jaccard_components_are_exact(spark, corpus):
    sets = [(i, shingles(t)) for i, t in corpus]
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    want = collections.Counter((i, len(s), None if i is None else least[root(k)]) for k, (i, s) in enumerate(sets))
    assert collections.Counter(map(tuple, jaccard.jaccard_components(frame(spark, corpus)).collect())) == want


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 20, 61, 300])
def test_similar_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    first = jaccard.bands(75, 2 * n + 10)
    for _ in range(60):
        union = rng.integers(0, 2**63, n).astype(np.uint64)
        apart = int(rng.integers(0, n // 4 + 1))
        cut = int(rng.integers(0, apart + 1))
        a, b = np.unique(union[apart:]), np.unique(np.concatenate([union[:cut], union[apart:]]))
        a = np.unique(np.concatenate([a, union[cut:apart]]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * len(np.union1d(a, b)) and common:
            assert len(np.intersect1d(jaccard.signatures(a, first, 75), jaccard.signatures(b, first, 75)))


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_lm_scores(spark, corpus):
    rows = corpus[:60]
    for order in (1, 2, 3):
        learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
        of = lambda t: (*tokens((t or "").encode()), "end")
        c = collections.Counter(w[k : k + n] for w in map(of, learned) for n in range(1, order + 1) for k in range(len(w) - n + 1))
        total, kinds = sum(v for g, v in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

        def p(g, c=c, total=total, kinds=kinds):
            if len(g) == 1:
                return (c[g] + 0.1) / (total + 0.1 * (kinds + 1))
            return (c[g] + lm.SHORTER * p(g[1:])) / (c[g[:-1]] + lm.SHORTER)

        want = collections.Counter()
        for i, t in rows:
            w = of(t)
            base = sum(math.log10(p((a,))) for a in w)
            score = sum(math.log10(p(w[max(0, k - order + 1) : k + 1])) for k in range(len(w)))
            want[(i, i is not None and zlib.crc32(str(i).encode()) % 10 != 0, len(w), sum(c[(a,)] > 0 for a in w), total, round(base, 6), round(score, 6))] += 1
        got = lm.score_texts(frame(spark, rows), id_crc(F.col("doc_id")) % 10 != 0, order=order).collect()
        assert collections.Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got) == want


def test_lm_of_empty_and_untrained_tables(spark):
    assert lm.score_texts(frame(spark, []), F.lit(True)).collect() == []
    (r,) = lm.score_texts(frame(spark, [(1, "a b")]), F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) < 1e-9


def test_lm_of_texts_too_short_for_longer_ngrams(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a")]
    got = lm.score_texts(frame(spark, rows), F.col("doc_id") != 4).collect()
    assert sorted(r[:5] for r in got) == [(1, True, 1, 1, 4), (2, True, 1, 1, 4), (3, True, 2, 2, 4), (4, False, 2, 2, 4)]
    assert {r.doc_id: round(r.base_score, 9) for r in got}[4] == round(math.log10(1.1 / 4.3) + math.log10(3.1 / 4.3), 9)


def test_lm_counts_words_apart_from_those_of_equal_short_keys(spark):
    """The keys of these two words, and of this word and this pair, agree in their last 42 bits: 40 within one of 4 buckets."""
    rows = [(1, "w1913584"), (2, "w3661768 and"), (3, "w95361 w1245818")]
    got = lm.score_texts(frame(spark, rows), F.col("doc_id") < 3)
    assert sorted((r.doc_id, r.n_known, r.train_tokens) for r in got.collect()) == [(1, 2, 5), (2, 3, 5), (3, 1, 5)]
    got = lm.score_texts(frame(spark, rows), F.lit(True))
    assert {r.train_tokens for r in got.collect()} == {8}


def test_window_centres_are_the_nodes_of_the_tree():
    rng = np.random.default_rng(0)
    for m in (46, 47, 200):
        for kinds in (10**9, 7, 1):
            values = rng.integers(0, kinds, (3, m)).astype(np.uint64)
            for least in (1, 5, 46):
                want = np.unique(np.concatenate([v[substrings.compact_windows(v, least)[:, 1]] for v in values]))
                assert (substrings.centres(values, least) == want).all()


def test_compact_windows_hold_every_run_once():
    values = np.random.default_rng(1).integers(0, 9, 40).astype(np.uint64)
    seen = collections.Counter()
    for a, c, b in substrings.compact_windows(values, 4):
        for i in range(a, c + 1):
            for j in range(c, b + 1):
                if j - i + 1 >= 4:
                    seen[i, j] += 1
                    assert values[c] == values[i : j + 1].min()
    assert seen == {(i, j): 1 for i in range(40) for j in range(i + 3, 40)}


def test_repeated_passages_are_found(spark):
    rng = random.Random(9)
    passage, other = prose(rng, 60), prose(rng, 50)
    rows = [*ODD, (10, " ".join(prose(rng, 90) + passage + prose(rng, 40))), (11, " ".join(prose(rng, 20) + passage)), (12, " ".join(prose(rng, 200)))]
    edited = list(passage)
    edited[30] = "changed"
    rows += [(13, " ".join(prose(rng, 33) + edited + prose(rng, 5))), (14, " ".join(other)), (15, " ".join(other[:49] + prose(rng, 30))), (16, "a a " * 60), (17, "b " + "a " * 100), (18, " ".join(prose(rng, 10) + other))]
    got = substrings.near_duplicate_passages(frame(spark, rows))
    spans = {(r.doc_id, r.match_doc_id): (r.start_word, r.end_word) for r in got.collect()}
    assert spans[11, 10] == (20, 80) and spans[18, 14] == (10, 60) and (13, 10) in spans or (13, 11) in spans
    assert not {12, 15} & {i for pair in spans for i in pair} and 17 in {i for i, _ in spans}
    left = dict(substrings.cut_passages(frame(spark, rows), got).where("doc_id >= 10").select("doc_id", "text").collect())
    assert left[11].split() == rows[len(ODD) + 1][1].split()[:20] and left[10] == rows[len(ODD)][1] and left[14] == rows[len(ODD) + 4][1]


def test_leaks(spark):
    rng = random.Random(2)
    items = [(k, " ".join(prose(rng, 20 + k))) for k in range(6)] + [(50, None), (51, ""), (52, "x y"), (None, "a b c d")]
    w = items[2][1].split()
    edited = [x if k % 6 else "other" for k, x in enumerate(w)]
    rows = [*ODD, (20, " ".join(prose(rng, 30)) + " " + items[0][1]), (21, items[1][1].upper()), (22, " ".join(prose(rng, 9) + edited + prose(rng, 99))), (23, " ".join(prose(rng, 300))), (24, " ".join(w[:8] + prose(rng, 30)))]
    got = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(20, 0), (21, 1), (22, 2)}
    assert [(r.start_word, r.end_word, r.score) for r in got if r.doc_id == 20] == [(30, 50, 1.0)]
    assert decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_texts_of_one_window_agree():
    rng, seq = random.Random(8), lambda t: substrings.sequence(" ".join(t).encode())
    missed = 0
    for _ in range(1000):
        w = prose(rng, 50)
        new = w[:24] + prose(rng, 2) + w[26:]
        x, p = set(seq(new)), set(seq(w))
        assert 100 * len(x & p) >= 75 * len(x | p)
        keys = [substrings.window_keys(seq(t), 46, substrings.HASHES) for t in (new, w)]
        missed += len(np.intersect1d(*keys)) < substrings.AGREE
    assert missed <= 2, missed


def test_edited_passages_against_brute_force():
    rng = random.Random(3)
    found = 0
    for k in range(200):
        w = prose(rng, rng.randint(50, 90))
        new = list(w)
        if k < 2:  # twelve words in one place
            w = prose(rng, 80)
            new = w[:40] + prose(rng, 12) + w[40:]
        for _ in range(rng.randint(0, 5) if k >= 2 else 0):
            at = rng.randrange(1, len(new) - 1)
            new[at : at + rng.randint(0, 1)] = prose(rng, rng.randint(0, 3))
        if k == 1:
            w, new = new, w
        seq = lambda t: substrings.sequence(" ".join(t).encode())
        x, p = seq(new), seq(w)
        like = len(x) >= 46 and 100 * len(set(x) & set(p)) >= 75 * len(set(x) | set(p))
        got = substrings.passages(seq(prose(rng, 30) + new + prose(rng, 30)), seq(prose(rng, 30) + w + prose(rng, 30)), 46, 75)
        assert got or not like
        found += like
        for a, b, c, d, sim in got:
            assert b - a >= 46 and sim >= 0.75
    assert found > 60


@pytest.mark.parametrize("kind", ["replace", "insert"])
def test_edited_leaks_against_brute_force(spark, kind):
    rng = random.Random(kind)
    items = [(k, " ".join(prose(rng, rng.randint(50, 100)))) for k in range(40)]
    rows = [(1000 + k, t) for k, t in items[::2]]  # verbatim copies elsewhere
    for k, t in items:
        w = t.split()
        for share in (0.15, 0.2, 0.25, 0.45):
            edits = sorted(rng.sample(range(len(w)), int(share * len(w))), reverse=True)
            new = list(w)
            for at in edits:
                new[at : at + (kind == "replace")] = prose(rng, 1)
            rows.append((len(rows), " ".join(prose(rng, 60) + new + prose(rng, 60))))
    rows += [(5000, " ".join([items[0][1], *prose(rng, 5), items[0][1]]))]
    word = collections.defaultdict(lambda: len(word))
    coded = lambda t: np.array([word[x] for x in t.split()])
    want = {(i, k) for i, t in rows for k, q in items if decontaminate.align(coded(q), coded(t))[0] >= len(q.split())}
    got = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 120
    assert sum(r.doc_id == 5000 and r.score == 1 for r in got) == 2


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        q, t = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        h = np.zeros((len(q) + 1, len(t) + 1), int)
        for i in range(1, len(q) + 1):
            for j in range(1, len(t) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == t[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(q, t)[0] == h.max()


def library(text):
    return pretokens.tokenizer(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, corpus):
    got = token_counts.token_counts(frame(spark, corpus), TOKENIZER, limit=50).collect()
    want = collections.Counter((i, len((t or "").encode()), len(library(t)), len(library(t)) > 50) for i, t in corpus)
    assert collections.Counter(map(tuple, got)) == want


def test_pre_tokens_are_the_library_s():
    rng = random.Random(0)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "'s", "'", "é", "1", "٣", "<|endoftext|>", "!", "中", "😀", "࢏", "₏"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        ids = pretokens.ids_of(TOKENIZER).of(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library(text), repr(text)


def test_packing_is_whole_and_gapless(spark, corpus):
    rows = [*corpus, (900, "word " * 5000)]
    got = packing.pack(frame(spark, rows), TOKENIZER, capacity=256).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = [*library(t), 0]
        first = len(ids) % 256 or 256
        for k, at in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[at : first if k == 0 else at + 256]
            want[(i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert len(by) <= 1.03 * -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack(frame(spark, []), TOKENIZER).collect() == []


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.clip(rng.lognormal(4, 0.9, 5000).astype(int), 1, 256), minlength=257)
    made = packing.plan(counts, 256)
    held = np.zeros(257, int)
    for pattern, n in made:
        assert sum(pattern) <= 256
        for a in pattern:
            held[a] += n
    assert (held == counts).all()
    assert sum(n for _, n in made) <= 1.01 * (counts * np.arange(257)).sum() / 256 + 1


def test_trees_learn_and_walk_alike():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x[:400], y[:400], rounds=30)
    assert ((trees.scores(x[400:]) > 0.5) == y[400:]).mean() > 0.95
    for row in x[:20]:
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while trees.left[t, node] != node:
                node = trees.right[t, node] if row[trees.feature[t, node]] > trees.threshold[t, node] else trees.left[t, node]
            total += trees.value[t, node]
        assert abs(total - trees.margins(row[None, :])[0]) < 1e-9


def test_quality_held_out_and_without_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.classify(docs, labels, id_crc(F.col("doc_id")) % 3 != 1)
    held = scored.join(labels, "doc_id").where(id_crc(F.col("doc_id")) % 3 == 1).select("quality", "score").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in held]) > 0.9
    none = quality.classify(frame(spark, ODD), labels.limit(0), F.lit(True)).collect()
    assert len(none) == len(ODD) and {r.score for r in none} == {0.5}


def test_scattered_pieces_hide_no_repeat(spark):
    """Passages that are whole in two documents, with 28 documents before and between that hold 12 of their words."""
    rng, rows, whole = random.Random(17), [], []
    for k in range(20):
        w, at = prose(rng, 60), 1000 * k
        piece = lambda w=w: " ".join([*prose(rng, 40), *w[(s := rng.randrange(48)) : s + 12], *prose(rng, 40)])
        rows += [(at + j, piece()) for j in range(14)] + [(at + 100, " ".join([*prose(rng, 30), *w, *prose(rng, 30)]))]
        rows += [(at + 200 + j, piece()) for j in range(14)] + [(at + 300, " ".join([*prose(rng, 30), *w, *prose(rng, 30)]))]
        whole.append((at + 300, at + 100))
    got = {(r.doc_id, r.match_doc_id): (r.start_word, r.end_word) for r in substrings.near_duplicate_passages(frame(spark, rows)).collect()}
    assert set(got) == set(whole) and all(a <= 30 and b >= 90 for a, b in got.values())


def test_near_passages_against_brute_force(spark):
    """Every document that has a stretch like one of an earlier document has a row, and the rows cover nine tenths of such stretches' words."""
    rng, rows = random.Random(23), []
    for k in range(12):
        w = prose(rng, rng.randint(60, 120))
        for j in range(6):
            new = list(w)
            for _ in range(rng.randint(0, len(w) // 30)):
                new[rng.randrange(len(new))] = "edited" + str(j)
            rows.append((100 * j + k, " ".join([*prose(rng, 20), *new, *prose(rng, 20)])))
    seq = {i: substrings.sequence(t.encode()) for i, t in rows}
    want = collections.defaultdict(set)
    for b in seq:
        for a in seq:
            if a < b:
                for s, e, *_ in substrings.passages(seq[b], seq[a], 46, 75):
                    want[b].update(range(s, e + 4))
    got = collections.defaultdict(set)
    for r in substrings.near_duplicate_passages(frame(spark, rows)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert set(got) == set(want) and sum(len(got[b] & want[b]) for b in want) >= 0.9 * sum(map(len, want.values()))


def test_long_alignments_need_no_table():
    rng = np.random.default_rng(6)
    q, t = rng.integers(0, 5000, 4000), rng.integers(0, 5000, 40_000)
    t[20_000:24_000] = q
    assert decontaminate.align(q, t) == (8000, 0, 4000, 20_000, 24_000)


def test_empty_tables(spark):
    docs, items = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert substrings.near_duplicate_passages(docs).collect() == [] and token_counts.token_counts(docs, TOKENIZER).collect() == []
    assert decontaminate.find_leaks(docs, some).collect() == [] and decontaminate.find_leaks(docs, items).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, labels, F.lit(True)).collect() == []


def test_frequent_lengths_are_the_library_s(spark, corpus):
    found = token_counts.frequent_lengths(frame(spark, corpus), TOKENIZER, rows=50, most=300)
    assert len(found) == 300 and all(n == len(library(t)) for t, n in found.items())


def test_repeated_labelled_ids_stay_bounded(spark):
    rows = [(k % 3, "good words of prose " * (1 + k % 7)) for k in range(300)]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    scored = quality.classify(frame(spark, rows), labels, F.lit(True)).collect()
    assert len(scored) == 300 and all(0 <= r.score <= 1 for r in scored)


def test_pairs_with_a_pivot_leave_a_task_once(spark):
    """The pairs of near copies grow as their number, and no pair is a row of several buckets' tasks."""
    base, counts = np.random.default_rng(4).integers(0, 2**62, 60), []
    for n in (100, 400):
        rows = [(k, k, sorted({*base.tolist()[:57], *range(3 * k, 3 * k + 3)})) for k in range(n)]
        stars = jaccard._stars(spark.createDataFrame(rows, "set_id long, rank long, shingles array<long>"), jaccard.bands(75, 60), 75, 32)
        assert "HashAggregate" not in stars._jdf.queryExecution().toString()
        found = stars.collect()
        counts.append(len(found))
        assert len(found) == len(set(found)) and {r.a for r in found} == set(range(1, n))
    assert counts[1] <= 5 * counts[0]


def test_short_earlier_texts_are_matched(spark):
    """An earlier text of 48 words, which later passages of 51 words repeat but for 3 words between."""
    rng, rows = random.Random(31), []
    for k in range(8):
        w = prose(rng, 48)
        rows += [(k, " ".join(w)), (100 + k, " ".join([*prose(rng, 20), *w[:24], *prose(rng, 3), *w[24:], *prose(rng, 20)]))]
    seq = {i: substrings.sequence(t.encode()) for i, t in rows}
    want = {(b, a) for b in seq for a in seq if a < b and substrings.passages(seq[b], seq[a], 46, 75)}
    assert want == {(100 + k, k) for k in range(8)}
    assert {(r.doc_id, r.match_doc_id) for r in substrings.near_duplicate_passages(frame(spark, rows)).collect()} == want
