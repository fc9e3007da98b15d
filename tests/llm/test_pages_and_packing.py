"""WARC round trips, main-text extraction, packing, the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import check, duck
from proofline.llm import htmlcrf, labelled_pages, packing, warc
from proofline.llm.common import work_dir

from .test_pair_operators import plain_components, plain_leaks
from .test_text_operators import docs, odd

PAGES = "page_id bigint, url string, html string"


def test_warc_twin(spark, sf):
    ok, note = check(spark, duck(sf), "op3_warc_segments", sf)
    assert ok, note


def expected(rows, revisit_from):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= revisit_from:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = first.get(p)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if to is not None and to != i else "response", to if to != i else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment,chunk,revisit_from", [(32768, 8192, 0), (64, 7, 0), (100, 1000, 5)])
def test_warc_round_trip(spark, segment, chunk, revisit_from):
    rows = [(1, "http://a/ b", "x" * 500), (2, None, "x" * 500), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 40), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 40),
            (None, "u", "x" * 500), (None, "n", "only null " * 30), (6, "u", "abc"), (7, "u", "abc"), (8, "u", "y" * 200_000)]
    path = work_dir(spark, "test")
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS id", "2 AS payload", "3 AS digest", "4 AS size")
    warc.write_archives(warc.plan_records(table, revisit_from), path, segment, chunk)
    got = [(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()]
    assert sorted(got, key=str) == expected(rows, revisit_from)


def test_warc_empty_table(spark):
    path = work_dir(spark, "test")
    warc.write_archives(warc.plan_records(spark.createDataFrame([], PAGES)), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc_detects_missing_segments(spark):
    row = spark.createDataFrame([(1, "u", "z" * 1000)], PAGES)
    path = work_dir(spark, "test")
    warc.write_archives(warc.plan_records(row), path, 200, 50)
    records = warc.read_records(spark, path)
    assert warc.reassemble(records).count() == 1
    bad = warc.reassemble(records.filter("number <> 2")).first()
    assert (bad.id, bad.record_type, bad.payload_bytes) == (1, "error", None) and "incomplete record" in bad.error


def test_warc_goes_on_after_damage(spark, tmp_path):
    """A broken record or archive is an error row; everything around it is read."""
    def response(page, html, size=None, body=None):
        block = warc.HTTP_HEAD + (warc.chunked(html, 7) if body is None else body)
        return (f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: {page}\r\nContent-Length: {len(block) if size is None else size}".encode()
                + warc.END + block + warc.END)

    good = response(1, b"one") + response(2, b"two")
    packed = gzip.compress(response(7, b"seven")) + gzip.compress(response(8, bytes(range(256)) * 40))
    files = {"part-a": good,
             "part-b": b"rubbish\r\n\r\n" + response(3, b"three") + response(4, b"", size="x") + response(5, b"five", body=b"9\r\nshort\r\n") + response(6, b"six", size=10**6),
             "part-c": packed[:-40], "part-d": b"\x1f\x8b no gzip"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.payload_bytes) for r in got if r.error is None) == [(1, 3), (2, 3), (3, 5), (7, 5)]
    reasons = sorted(r.error.rsplit("/", 1)[1] for r in got if r.record_type == "error")
    assert [r[:6] for r in reasons].count("part-b") == 4 and len([r for r in reasons if r.startswith("part-c")]) == 2
    for part in ("part-b: no record at byte 0", "part-b: no length", "part-b: broken chunk framing", "part-b: record cut off", "part-c: gzip data cut off", "part-d: damaged gzip"):
        assert any(r.startswith(part) for r in reasons), (part, reasons)
    assert all(r.id == 5 for r in got if r.error and "framing" in r.error)


def test_chunk_framing():
    for data in (b"", b"a", b"abc" * 1000):
        assert warc.dechunked(warc.chunked(data, 7)) == data
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


@pytest.fixture(scope="module")
def crf():
    return htmlcrf.trained()


def test_crf_on_held_out_pages(crf):
    wrong = total = 0
    for page, labels in labelled_pages.labelled_pages(150, 50_000):
        got = crf.decode(htmlcrf.page_features(htmlcrf.leaf_blocks(page), {}))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong / total < 0.01


def test_crf_decodes_the_best_path(crf):
    import itertools

    page = labelled_pages.labelled_pages(1, 77)[0][0]
    features = htmlcrf.page_features(htmlcrf.leaf_blocks(page), {})[:9]

    def value(labels):
        emit = sum(crf.weights[crf.index[x], y] for f, y in zip(features, labels) for x in f if x in crf.index)
        return emit + sum(crf.moves[a, b] for a, b in zip(labels, labels[1:]))

    assert abs(value(crf.decode(features)) - max(map(value, itertools.product((0, 1), repeat=len(features))))) < 1e-9


def test_extraction_matches_markup(spark, sf):
    """The given pages mark their article; the model has to find the same blocks."""
    got = {r.page_id: r for r in entry.queries()["op5_crf_extraction"](spark, sf).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        want = "\n".join(b.text for b in htmlcrf.leaf_blocks(html) if any(t == "article" for t, _ in b.path))
        assert got[page_id].text == want and got[page_id].url == url and got[page_id].n_chars == len(want)


def test_leaf_blocks():
    page = """<!doctype html><!-- <p>no --><head><title>no</title></head><body><ul><li>one<li>two &amp;lt; <b>three</b>
      four</ul><script>if (a < b) "</p>"</script><p class="leadText x-1" id=top>a&nbsp;b<br>c<p>d 1 < 2<div>e</div>tail<style>p{}</style>"""
    got = [(b.text, b.path[-1][0] if b.path else "") for b in htmlcrf.leaf_blocks(page)]
    assert got == [("one", "li"), ("two &lt; three four", "li"), ("a b c", "p"), ("d 1 < 2", "p"), ("e", "div"), ("tail", "body")]
    assert htmlcrf.attribute_words(' class="leadText x-1" id=top') == ("lead", "text", "x", "top")
    assert htmlcrf.leaf_blocks("") == [] and htmlcrf.leaf_blocks("<p") == [] and [b.text for b in htmlcrf.leaf_blocks("<!-- x <p>y")] == []


@pytest.mark.parametrize(("page", "want"), [
    ("<head><title>t</title><body><article><p>a</p><p>b</p></article>", ["a", "b"]),  # the end tag of a head may be left out
    ("<head><meta charset=x><link rel=y><noscript><style>p</style></noscript><p>a", ["a"]),
    ("<head><title>t</title></head><p>a", ["a"]),
    ("<p>a</p><svg width='1'/><p>b</p><math/><p>c", ["a", "b", "c"]),
    ("<p>a<svg><title>t</title><svg><path/></svg><text>x</text></svg>b</p><p>c", ["ab", "c"]),
    ("<div><iframe src=x></div><p>a</p><iframe>no</iframe><p>b", ["a", "b"]),
    ("<p>a</p><iframe src=x><p>b</p><canvas><p>c", ["a", "b", "c"]),
    ("<object><object>no</object>no<div>no</div></object><p>a</p><template><p>no</p></template><noscript>no</noscript>b", ["a", "b"]),
    ("<p>a</p><script>if (a < b) '<p>no'", ["a"]),
    ("<p>The value of it <script>x</script> is well known</p>", ["The value of it is well known"]),
    ("<p>The value of it <math><mi>x</mi></math> is <noscript>no</noscript>well<iframe src=x>no</iframe> known</p>", ["The value of it is well known"]),
    ("<p>a <style>p{}</style>b<template><p>no</p></template> c</p>d", ["a b c", "d"]),
])
def test_skipped_elements_end(page, want):
    assert [b.text for b in htmlcrf.leaf_blocks(page)] == want


@pytest.mark.parametrize(("page", "want"), [
    ("<div>plain words only without any stop</div>", "plain words only without any stop"),
    ("Bare text, no element at all.", "Bare text, no element at all."),
    ("bare words", "bare words"),
    ("<p>A lone paragraph.</p>", "A lone paragraph."),
    ("<html><head><title>no</title></head><body><p>One part.<p>Another <a href=x>part</a> of it.</body></html>", "One part.\nAnother part of it."),
    ("<p>The value of it <script>x</script> is well known.</p>", "The value of it is well known."),
    ("<ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>Some text that is read.</p>", "Some text that is read."),
])
def test_pages_without_furniture(crf, page, want):
    assert htmlcrf.main_text(crf, page, {}) == want


def test_extraction_odd_rows(spark, crf):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>x</a></nav>"), (None, "u", "<article><p>Some words here.</p></article>"), (4, "u", "<article>" + "<p>Long text here." * 20_000), (4, "u", "<b")]
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS n_chars")
    got = [(r.page_id, r.url, r.n_chars) for r in htmlcrf.extract(table, crf).collect()]
    assert got == [(1, "u", 0), (2, None, 0), (3, "u", 0), (None, "u", 16), (4, "u", 20_000 * 16 - 1 + 0), (4, "u", 0)]
    assert htmlcrf.extract(spark.createDataFrame([], PAGES), crf).count() == 0


def check_packing(rows, tokens_of, size=1024):
    """Every id once, power-of-two lengths, one document and piece per sequence."""
    by_doc = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and 0 < r.length <= size and r.offset == 0
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d, pieces in by_doc.items():
        want, at = tokens_of(d), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            ids = want[at:at + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
            at += r.length
        assert at == len(want)


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = entry.queries()["op10_binary_packing"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check_packing(rows, lambda d: [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0])


def test_encoder_matches_the_tokenizer(monkeypatch):
    encoder = packing.Encoder(corpus_pipeline.TOKENIZER, 0)
    texts = ["a  b", " x", "x ", "a\n b", "a \n b", "it's 5 o'clock\t x", "ab\n\n c d\n", "\n", "é ß ñ 漢字 \U0001f600", "x <|endoftext|> y", " ", "a　b   c", "don't 'llx 's " * 30]
    for piece in (100_000, 1, 4):
        monkeypatch.setattr(packing, "PIECE_CHARS", piece)
        for t in texts:
            assert encoder.encode(t).tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_packing_odd_rows(spark, tmp_path):
    assert packing.piece_lengths(1024 + 512 + 5, 1024) == [1024, 512, 4, 1] and packing.piece_lengths(0, 1024) == []
    clash = odd(spark).selectExpr("*", "1 AS start", "2 AS ids", "3 AS bucket", "4 AS length")
    packed = packing.pack(clash, corpus_pipeline.TOKENIZER, size=256)
    rows = packed.collect()
    assert [(r.length, r.doc_tokens, list(r.ids)) for r in rows if r.doc_id in (1, 2)] == [(1, 1, [0])] * 2
    assert sum(r.doc_id == 4 for r in rows) == 2 * sum(r.doc_id is None for r in rows)
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(docs(spark, []), corpus_pipeline.TOKENIZER).count() == 0
    packing.write_buckets(packed, f"{tmp_path}/buckets")
    assert spark.read.parquet(f"{tmp_path}/buckets").groupBy("bucket").agg(F.max("length").alias("m"), F.min("length").alias("n")).filter("bucket <> m OR bucket <> n").isEmpty()
    with pytest.raises(ValueError):
        packing.pack(clash, corpus_pipeline.TOKENIZER, size=1000)


def test_stages_against_plain_versions(spark, sf, tmp_path):
    """Each stage on what its predecessor kept."""
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "similar", "leaks", "pack"]
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    base, reached = spark.read.parquet(f"{sf}/documents.parquet").limit(200), []
    docs_in = base.unionByName(spark.createDataFrame([(900_001, "12 34", None, None, 5), (900_002, None, "en", "s", None)], base.schema))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs_in.collect()}
        stage(spark, docs_in, sf).write.parquet(f"{tmp_path}/{name}")
        docs_in = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs_in.collect()}
        reached.append(name)
        if name != "pack":
            assert docs_in.columns == columns and all(r.n_chars == len(r.text) for r in after.values())
        if name == "language":
            assert set(before) - set(after) == {900_001, 900_002}
        elif name == "lines":
            assert all(set(after[d].text.split("\n")) <= set(before[d].text.split("\n")) for d in after)
        elif name == "similar":
            want = plain_components([(d, r.text) for d, r in before.items()], 5, 80, 100)
            assert set(after) == {d for d, (_, c, _) in want.items() if c == d}
        elif name == "leaks":
            items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
            leaked = {d for d, _ in plain_leaks([(d, r.text) for d, r in before.items() if any(w in r.text for _, t in items for w in [" ".join(re.split(r"\s+", t)[3:7])])], items)}
            assert set(after) == set(before) - leaked
        else:
            tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
            check_packing(docs_in.collect(), lambda d: [*tokenizer.encode(before[d].text, add_special_tokens=False).ids, 0])
