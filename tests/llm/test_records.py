"""TIFF, WARC and quotations."""

from __future__ import annotations

import base64
import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from prismora.llm import queries, quotes, tiff, warc

ODD = [(1, None), (2, ""), (3, "ab"), (3, "ab"), (None, "null id"), (4, "x" * 64), (5, "long " * 5000), (6, "é" * 33)]


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, bytes(7000), np.random.default_rng(0).integers(0, 256, 9000, dtype=np.uint8).tobytes(), b"the quick brown fox " * 900])
def test_codecs_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data


def test_lzw_of_the_format_s_example():
    """Codes 256 7 258 8 8 258 6 6 257 in nine bits each."""
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    want = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_encode(data) == want and tiff.lzw_decode(want) == data


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "f4", "f8"])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.ADOBE_DEFLATE, tiff.PACKBITS, tiff.DEFLATE])
def test_pages_round_trip(kind, compression):
    rng = np.random.default_rng(3)
    for predictor in (1, 2) if kind[0] == "u" else (1, 3):
        for tile in (0, 16):
            for e in "<>":
                pages = [(rng.random((37, 21, s)) * 200).astype(kind) for s in (1, 3)]
                file = tiff.write_tiff([tiff.Page(p, compression, predictor, tile, 10) for p in pages], e)
                got = [tiff.read_page(file, t).pixels for t in tiff.directories(file)]
                assert len(got) == 2 and all((a == b).all() for a, b in zip(got, pages))


def test_tiff_pages_and_broken_files(spark):
    px = np.arange(64, dtype=np.uint8).reshape(8, 8, 1)
    good = tiff.write_tiff([tiff.Page(px, tiff.LZW), tiff.Page(px[:4], tiff.PACKBITS, 2)])
    media = spark.createDataFrame([(1, bytearray(good), "x"), (2, None, "x"), (3, bytearray(b"II*\0"), "x"), (4, bytearray(good[:40]), "x")], "id long, content binary, pixels string")
    rows = tiff.tiff_pages(media, "id", "content").collect()
    assert [(r.page, bytes(r.pixels)) for r in sorted(rows, key=lambda r: (r.id, r.page)) if r.id == 1] == [(0, px.tobytes()), (1, px[:4].tobytes())]
    assert all(r.error for r in rows if r.id > 1) and {r.id for r in rows} == {1, 2, 3, 4}


def test_op1_digests(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_tiff_pages(spark, str(tmp_path)).collect()
    want = collections.Counter()
    for i, t in ODD:
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 3}) == 1


def test_warc_round_trip(spark):
    big = "".join(map(chr, np.random.default_rng(1).integers(32, 2000, 60_000)))
    rows = [(4, "http://a/", "same"), (2, None, "same"), (7, "http://b/ c", "same"), (1, "http://d/", None), (3, "", ""), (5, "u", "é" * 70_000), (6, "u", big), (8, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    want = set()
    for i, _, h in rows:
        data = (h or "").encode()
        own = first[h or ""]
        want.add((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own == i else "revisit", None if own == i else own))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
    assert not any(r.error for r in got)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_warc_with_a_long_url(spark):
    pages = spark.createDataFrame([(k, "http://a/" + "x" * n, f"page {k}") for k, n in enumerate((5, 300_000, 7))], "page_id long, url string, html string").coalesce(1)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert {r.page_id: (len(r.target_uri), bytes(r.payload), r.error) for r in got} == {0: (14, b"page 0", None), 1: (300_009, b"page 1", None), 2: (16, b"page 2", None)}


def test_warc_damage_is_told():
    a = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:AAAA")], b"payload")
    assert [e for *_, e in warc.read_records(a + a)] == ["block digest differs"] * 2
    whole = warc.record([("WARC-Type", "response")], b"x" * 100_000)
    assert [(len(b), e) for _, b, e in warc.read_records(whole * 3)] == [(100_000, None)] * 3
    with pytest.raises(ValueError):
        list(warc.read_records(whole[:-20]))


CONVERSATIONS = [
    (1, 0, "u", "Hello there.\nHow  are you?\n\nFine day."), (1, 1, "a", "> Hello there.\n> how are you?\nGood."), (1, 2, "u", ">> fine day.\n> Good.\nIndeed\n\n bye "), (1, 3, "a", "> > Good.\n> Indeed\n\nOK > no"),
    (1, 4, "u", "> nothing known\nx"), (1, 5, "a", None), (2, 0, "u", "> Good.\nself"), (2, 1, "u", ""), (2, 2, "u", ">self\n> Good."), (2, 3, "u", "> >  self\n\n>self"),
]


def test_quotations_equal_the_sql(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(CONVERSATIONS, columns=["conv_id", "turn", "role", "text"]))
    got = quotes.link_quotations(df)
    names = [d[0] for d in con.execute(quotes.SQL).description]
    assert set(map(tuple, got.select(*names).collect())) == set(con.execute(quotes.SQL).fetchall())


def test_parts_of_passages_are_linked(spark):
    long = "First line here\nsecond line here\nthird line here\n\nAnother paragraph\n\nThe last paragraph"
    rows = [
        (1, 0, long), (1, 1, "> First line here\n> second line here\nanswer"), (1, 2, "> Another paragraph\n>\n> The last paragraph\nyes"),
        (1, 3, "> yes\none answer\nof two lines\n> Another paragraph\nmore to say\non this"), (1, 4, ">> yes\n> one answer\n> of two lines\n>> Another paragraph\n> more to say\n> on this\nall right"),
        (1, 5, "> nothing that\n> anybody said"),
    ]
    got = quotes.link_quotations(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.reply_to, r.thread_root, r.n_quotes, r.n_linked) for r in got} == {0: (None, 0, 0, 0), 1: (0, 0, 1, 1), 2: (0, 0, 1, 1), 3: (2, 0, 2, 2), 4: (3, 0, 4, 4), 5: (None, 5, 1, 0)}


def test_quotations_with_nulls_and_repeats(spark):
    rows = [*CONVERSATIONS, (1, 1, "a", "> Hello there.\n> how are you?\nGood."), (None, 0, "u", "> Good."), (1, None, "u", "> Good."), (3, 0, None, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, hash int")
    got = quotes.link_quotations(df).collect()
    assert len(got) == len(rows)
    assert [r.reply_to for r in got if (r.conv_id, r.turn) == (1, 1)] == [0, 0]
    assert all(r.reply_to is None for r in got if r.conv_id is None or r.turn is None)
    assert quotes.link_quotations(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(map(tuple, df.select(*names).collect())) == collections.Counter(found.fetchall())


def test_warc_of_repeated_page_ids(spark):
    """A row goes by its own payload: page 5 has one that page 3 has, too, and one of its own."""
    rows = [(3, "u", "A"), (5, "u", "A"), (5, "u", "B"), (7, "u", "C"), (7, "u", "C"), (None, "u", "A"), (None, "u", "D")]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert collections.Counter((r.page_id, bytes(r.payload or b""), r.record_type, r.refers_to) for r in got) == collections.Counter([(3, b"A", "response", None), (5, b"", "revisit", 3), (5, b"B", "response", None), (7, b"C", "response", None), (7, b"C", "response", None), (None, b"", "revisit", 3), (None, b"D", "response", None)])


def test_long_texts_go_through_tiles(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * 20_000) for k in range(12)], "doc_id long, text string")
    media = tiff.encode_texts(docs).select("id", "media")
    pages = tiff.tiff_pages(media, "id", "media").collect()
    assert {r.layout for r in pages} == {"tiles", "strips"} and all(bytes(r.pixels).rstrip(b"\0").decode() == f"text {r.id} " * 20_000 for r in pages)


def test_strips_that_claim_less_than_they_hold():
    data = b"x" * 100_000
    assert len(tiff.packbits_decode(tiff.packbits_encode(data), 50)) < 300 and len(tiff.lzw_decode(tiff.lzw_encode(data), 50)) < 9000
