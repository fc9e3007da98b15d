"""Source divergence audit against a plain version and its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import check, duck
from proofline.llm import common, divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain(rows, least=3, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        words = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [w for w, n in docs[lang].items() if n >= least]
        mine = {s: c for (la, s), c in groups.items() if la == lang}
        mine[None] = sum((mine[s] for s in list(mine)), Counter())
        share = {}
        for s, c in mine.items():
            total = sum(c[w] for w in kept) + len(kept)
            share[s] = {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in mine:
            if s is None:
                continue
            pairs = [(-sum(f(share[s][w], share[t][w]) for w in kept), t.encode(), t) for t in mine if t is not None and t != s]
            terms = [(-f(share[s][w], share[None][w]), w.encode(), w) for w in kept if mine[s][w] > 0 and share[s][w] > share[None][w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, n + 1) for n, (value, _, item) in enumerate(items)]
    return sorted(out)


def got(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), **options).collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "größe", "naïve", "straße", "señor", "日本", "日本語", "ab", "abc", "abcd", "abcdefgh", "abcdefghijklmnopq", "x" * 70, "É"]
    words += ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "-", "\n", "1"]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice([text, text, text, text, None]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "s3", "s4", "é", None]), 0))
    return rows


@pytest.mark.parametrize("options", [{}, {"first_length": 1, "bits": 8, "chunk_sources": 2, "block_terms": 5}, {"first_length": 200, "top_terms": 3}])
def test_matches_plain_version(spark, options):
    rows = corpus(150, 1)
    assert got(spark, rows, **options) == plain(rows, top=options.get("top_terms", 200))


def test_small_slices_and_tallies(spark, monkeypatch):
    """Documents cut into slices, many tallies a batch, a document longer than a tally."""
    rows = corpus(90, 2) + [(1000 + i, " ".join(r[1] or "" for r in corpus(60, 3)), "en", "s1", 0) for i in range(3)]
    frame = [dict(zip(("salt", "text"), (5, r[1]))) for r in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist(frame, pa.schema([("salt", pa.int64()), ("text", pa.string())]))

    def counts():
        out = Counter()
        for b in divergence._counter(3, 0, None, 26)(iter([batch])):
            for r in b.to_pylist():
                out[r["key"], "docs"] += r["docs"]
                out[r["key"], "longer"] |= r["longer"]
        return out

    want = counts()
    monkeypatch.setattr(divergence, "FLUSH_DOCS", 7)
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 20)
    monkeypatch.setattr(divergence, "slices", lambda d, o, b: common.slices(d, o, b, 50))
    assert counts() == want
    monkeypatch.setattr(divergence, "GROWTH", 2)
    assert got(spark, rows) == plain(rows)  # the workers have their own constants; the plan and levels are the same


def test_terms_of_a_batch_in_small_tallies(monkeypatch):
    import pyarrow as pa

    class Full:
        value = np.full(1 << 20, (1 << 64) - 1, np.uint64)

    rows = corpus(90, 4) + [(1000 + i, " ".join(r[1] or "" for r in corpus(60, 3)), "en", "s1", 0) for i in range(3)]
    batch = pa.RecordBatch.from_pylist([{"lang": r[2] or "", "source": r[3] or "", "salt": 7, "text": r[1] or ""} for r in rows])

    def counts():
        out = Counter()
        for b in divergence._counted(4, Full, 26)(iter([batch])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "count"] += r["count"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out

    want = Counter()
    for _, text, lang, source, _ in rows:
        words = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        for w, n in Counter(words).items():
            want[lang or "", source or "", w, "count"] += n
            want[lang or "", source or "", w, "docs"] += 1
    assert counts() == want
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 20)
    monkeypatch.setattr(divergence, "slices", lambda d, o, b: common.slices(d, o, b, 50))
    assert counts() == want


def test_only_prefixes_of_frequent_terms_reach_the_next_level(spark, monkeypatch):
    rows = [(i, f"common rare{i:03d}x".translate(str.maketrans("0123456789", "qwertyuiop")) + " commonplace", "en", "s", 0) for i in range(100)]
    staged, sizes = divergence.staged, []

    def spy(df, name):
        out = staged(df, name)
        if name == "prefixes":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(divergence, "staged", spy)
    assert got(spark, rows, first_length=4) == plain(rows)
    assert sizes == [2, 2]  # comm and rare; common and commonplace, no rare word


def test_odd_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None, None, 0)]) == []
    two = [(1, "a b", "en", "s", 0), (2, "a", "en", None, 0), (None, "b", "en", "s", 0)]
    assert got(spark, two) == plain(two) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]
    same = [(1, "a b b", "en", "s", 0)] * 4 + [(1, "a", "en", "t", 0)]
    assert got(spark, same) == plain(same)
    long = [(i, "alpha beta " * 200_000, "en", f"s{i % 2}", 0) for i in range(4)]
    assert got(spark, long) == plain(long)
    clash = spark.createDataFrame(same, SCHEMA)
    for c in ("term", "salt", "p", "q", "chunk", "block", "key", "value", "rank", "n", "v"):
        clash = clash.withColumn(c, F.lit("x"))
    assert sorted(tuple(r) for r in divergence.audit(clash).collect()) == plain(same)


def test_counts_beyond_long_arithmetic(spark):
    for n, total in ((0, 7), (9_223_372_035, 10**10), (9_223_372_036, 10**10), (5 * 10**11, 10**12), (10**15, 10**15 + 1)):
        row = spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(total).cast("bigint").alias("t"))
        assert row.select(F.expr(divergence.share("n", "t"))).first()[0] == 1 + 10**9 * (n + 1) // total


def test_query_and_its_sql(spark, sf):
    ok, note = check(spark, duck(sf), "op11_prefix_divergence", sf)
    assert ok, note


def test_a_level_counts_only_terms_that_go_on(spark):
    """A term that an earlier level took whole is not counted again, and is still found."""
    long = "averylongtermindeed"
    docs = spark.createDataFrame([("en", f"s{i % 2}", f"abc {long} only{chr(97 + i)}") for i in range(4)], "lang string, source string, text string")
    every = spark.sparkContext.broadcast(np.full(1 << 4, (1 << 64) - 1, np.uint64))
    rows = docs.select(F.xxhash64("lang").alias("salt"), "text")
    schema = "key bigint, docs bigint, longer boolean"
    assert rows.filter("text LIKE '%onlya'").mapInArrow(divergence._counter(16, 4, every, 10), schema).count() == 2  # the long term, onlya
    assert rows.mapInArrow(divergence._counter(64, 32, every, 10), schema).count() == 0
    got = {(r.source, r.term): (r["count"], r.docs) for r in divergence.frequent_terms(docs, 3).collect()}
    assert got == {(s, t): (2, 2) for s in ("s0", "s1") for t in ("abc", long)}
