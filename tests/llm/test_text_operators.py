"""Licence digests, language mixtures, FTRL, decision lists, template lines: values, plain versions, odd rows."""

from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from compare import check, duck
from proofline.llm import ftrl, langid, licences, linededup, rules
from proofline.llm.common import held_out

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, a null id."""
    return docs(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"),
                        (5, "word " * 60_000), (6, "x" * 300_000), (7, "1 2 3 !")])


@pytest.mark.parametrize("name", ["op1_license_digests", "op9_template_lines"])
def test_twins(spark, sf, name):
    ok, note = check(spark, duck(sf), name, sf)
    assert ok, note


def test_license_canonical_forms(spark):
    mit = licences.KNOWN["MIT"][0]
    texts = [mit, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace(",", " ,"),
             mit + " more", "see below\nlicenced under the apache LICENCE, version 2.0\nbye", None, "", "All rights reserved."]
    got = {r.doc_id: r for r in licences.scan(docs(spark, list(enumerate(texts))), licences.known_digests(spark)).collect()}
    assert [got[i].license for i in range(7)] == ["MIT", "MIT", None, None, None, None, "all rights reserved"]
    assert got[3].notices == "Apache-2.0 notice" and got[0].digest == got[1].digest and got[4].digest is None
    clash = docs(spark, [(1, "x")]).selectExpr("*", "1 AS digest", "2 AS license", "3 AS c", "4 AS id")
    assert licences.scan(clash, licences.known_digests(spark)).count() == 1
    assert licences.scan(odd(spark), licences.known_digests(spark, {})).filter("license IS NOT NULL").count() == 0
    assert licences.scan(docs(spark, []), licences.known_digests(spark)).count() == 0


def test_em_matches_plain_loop():
    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.ones(40), 3).T)
    counts = rng.integers(1, 9, 60)
    doc = np.sort(rng.integers(0, 4, 60))
    at = rng.integers(0, 40, 60)
    got = langid.mixtures(counts, doc, logs[at], 4, penalty=0.0, rounds=6)
    for d in range(4):
        n, like = counts[doc == d], np.exp(logs[at[doc == d]])

        def em(share):
            for _ in range(6):
                joint = share * like
                share = (n[:, None] * joint / joint.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
            return share, float(n @ np.log((share * like).sum(axis=1)))

        full, _ = em(np.full(3, 1 / 3))
        order = np.argsort(-full, kind="stable")
        best = max(float(n @ np.log(like[:, j])) for j in range(3))
        share = np.eye(3)[int(np.argmax([n @ np.log(like[:, j]) for j in range(3)]))]
        for size in (2, 3):
            if full[order[size - 1]] > 0.01:
                start = np.zeros(3)
                start[order[:size]] = full[order[:size]] + 1e-9
                s, value = em(start / start.sum())
                if value > best:
                    best, share = value, s
        assert np.allclose(got[d], share)


def test_language_on_held_out_rows(spark, sf):
    got = entry.queries()["op2_language_mixture"](spark, sf).toPandas()
    want = duckdb.sql(f"SELECT doc_id, lang, text FROM '{sf}/documents.parquet'").df().merge(got, on="doc_id")
    assert len(want) == len(got)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))
    assert (want.lang_pred == want.lang)[want.held_out].mean() > 0.97
    assert want.score.between(0, 1).all()


def test_language_mixtures_and_odd_rows(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    names, logs = langid.train(table)
    texts = duckdb.sql(f"SELECT lang, string_agg(text, ' ') FROM (SELECT lang, text FROM '{sf}/documents.parquet' WHERE lang IN ('de', 'es') AND n_chars > 500 ORDER BY doc_id LIMIT 40) GROUP BY 1").fetchall()
    half = {lang: text[:3000] for lang, text in texts}
    mixed = docs(spark, [(1, half["de"] + " " + half["es"]), (2, half["de"])])
    shares = {r.doc_id: r.shares for r in langid.predict(mixed, names, logs).collect()}
    assert set(shares[1]) >= {"de", "es"} and 0.3 < shares[1]["de"] < 0.7 and set(shares[2]) == {"de"}
    clash = odd(spark).selectExpr("*", "1 AS lang_pred", "2 AS shares", "3 AS _text")
    got = langid.predict(clash, names, logs, keep=("lang",)).collect()
    assert len(got) == 9 and {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert langid.train(docs(spark, []))[0] == [] and langid.predict(docs(spark, [(1, "abc")]), *langid.train(docs(spark, []))).first().lang_pred == "und"
    assert langid.predict(docs(spark, []), names, logs).count() == 0


def test_ftrl_update_matches_plain_loop():
    model = ftrl.Ftrl(4, 0.5, 1.0, 0.02, 0.01)
    z, n, rng = np.zeros(17), np.zeros(17), np.random.default_rng(1)
    for _ in range(50):
        at, x, y = np.sort(rng.choice(17, 5, replace=False)), rng.random(5), float(rng.integers(0, 2))
        model.update(at, x, y)
        w = [0.0 if abs(z[i]) <= 0.02 else -(z[i] - np.sign(z[i]) * 0.02) / ((1 + np.sqrt(n[i])) / 0.5 + 0.01) for i in at]
        p = 1 / (1 + np.exp(-np.dot(w, x)))
        for i, wi, xi in zip(at, w, x):
            g = (p - y) * xi
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / 0.5 * wi
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op4_ftrl_quality"](spark, sf).toPandas()
    rows = got.merge(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df(), on="doc_id")
    rows = rows[rows.held_out]
    good = rows.quality == 1
    assert ((rows.predicted == 1) == good).mean() > 0.9
    assert (rows.score[good].to_numpy()[:, None] > rows.score[~good].to_numpy()[None, :]).mean() > 0.95


def test_ftrl_odd_rows(spark):
    weights = ftrl.train(odd(spark), spark.createDataFrame([], "doc_id bigint, quality int"), "quality")
    assert not weights.any() and {r.score for r in ftrl.score(odd(spark), weights).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id bigint, quality int")
    weights = ftrl.train(odd(spark).selectExpr("*", "1 AS id", "2 AS y", "3 AS g"), labels, "quality")
    got = ftrl.score(odd(spark), weights, keep=("source",)).collect()
    assert len(got) == 9 and all(0 < r.score < 1 for r in got)
    assert ftrl.score(docs(spark, []), weights).count() == 0


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_plain_version(spark, sf):
    rng = np.random.default_rng(2)
    made = [(100 + i, "".join(rng.choice(list("ab \n\t\x0b#é")) for _ in range(rng.integers(0, 80)))) for i in range(60)]
    table = docs(spark, made + [(1, None), (2, ""), (3, "a a a a"), (4, "a b\na b\n\na b"), (5, "w " * 40_000)]).unionByName(
        spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars"))
    for r in rules.statistics(table).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r.text), r.doc_id


def test_rules(spark):
    rng = np.random.default_rng(4)
    x = rng.random((3000, 2))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)) | (x[:, 1] > 0.95)
    found = rules.learn(x, bad, ["a", "b"])
    hit = np.any([rules._covers(r, x, ["a", "b"]) for r in found], axis=0)
    assert (hit == bad).mean() > 0.98 and len(found) <= 4
    assert rules.learn(x, np.zeros(3000, bool), ["a", "b"]) == [] and rules.learn(np.zeros((0, 2)), np.zeros(0, bool), ["a", "b"]) == []
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op6_decision_list"](spark, sf).toPandas()
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all() and not (got.kept & got.base_failed).any()
    rows = got.merge(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df(), on="doc_id")
    rows = rows[~rows.base_failed & rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)]
    assert (rows.kept == (rows.quality == 1)).mean() > 0.95
    clash = odd(spark).selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS _f", "4 AS _row", "5 AS h")
    assert rules.judge(clash, found[:0]).filter("kept").count() == 0  # the long text repeats itself, the others are short
    assert rules.judge(docs(spark, []), []).count() == 0


def test_rules_are_native(spark, sf):
    plan = rules.judge(spark.read.parquet(f"{sf}/documents.parquet"), [[("n_words", ">=", 3.0)]])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def plain_lines(rows, depth=2, variants=10, agreement=0.7):
    """The rule of the template tree in plain Python: doc id to text."""
    kinds, sets = {}, {}
    for i, text in rows:
        for raw in (text or "").split("\n") if text is not None else []:
            line = raw.replace("\t", " ").replace("\r", " ").strip(" ")
            if not any(c.isalpha() or c.isnumeric() for c in line):
                continue
            tokens = line.split(" ")
            few = len(tokens) <= depth
            form = line if few else re.sub("[0-9]+", "0", line)
            kinds[line] = (form, few and len(line) <= 32, (len(tokens), " ".join(form.split(" ")[:depth])))
            sets.setdefault(i, set()).add(line)
    copies = {i: frozenset(kinds[x][0] for x in lines) for i, lines in sets.items()}
    where, by_form = {}, {}
    for i, lines in sets.items():
        for x in lines:
            where.setdefault(x, set()).add(i)
            by_form.setdefault(kinds[x][0], set()).add(copies[i])
    leaves = {}
    for x, ids in where.items():
        leaves.setdefault(kinds[x][2], set()).update(copies[i] for i in ids)
    fixed = Counter()
    leaf_of = {kinds[x][0]: kinds[x][2] for x in where}
    for form, n in by_form.items():
        for k, token in enumerate(form.split(" ")):
            fixed[leaf_of[form], k, token] += len(n)
    templates = {}
    for x, (form, _, leaf) in kinds.items():
        kept = tuple((k, w) for k, w in enumerate(form.split(" ")) if fixed[leaf, k, w] >= variants)
        busy = len(leaves[leaf]) >= variants
        templates.setdefault((leaf, kept) if busy and len(kept) >= math.ceil(agreement * len(form.split(" "))) else form, set()).add(x)
    gone = {}
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    for x, ids in where.items():
        if len({copies[i] for i in ids}) >= (variants if kinds[x][1] else 2):
            for i in ids - {low(ids)}:
                gone.setdefault(i, set()).add(x)
    for lines in templates.values():
        ids = set().union(*(where[x] for x in lines))
        if len({copies[i] for i in ids}) >= variants:
            for i in ids - {low(ids)}:
                gone.setdefault(i, set()).update(lines)
    return sorted(((i, text if text is None else "\n".join(r for r in text.split("\n") if r.replace("\t", " ").replace("\r", " ").strip(" ") not in gone.get(i, ())))
                   for i, text in rows), key=str)


def kept_lines(spark, rows):
    return sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(docs(spark, rows)).collect()), key=str)


def word(*seed):
    return "".join(chr(97 + b % 26) for b in zlib.crc32(repr(seed).encode()).to_bytes(4, "big")) + "q"


def test_template_tree_matches_plain_rule(spark):
    """A block in many documents, rare repeats, several templates in a leaf, fields that vary, copies, brackets, odd rows."""
    rows = []
    for i in range(200):
        lines = [f"own line {word(i)} {word(i, 1)} {word(i, 2)}"]
        if i < 60:
            lines += ["first of the shared block", "second of the shared block", "third", "fourth of the block"]
        if i % 22 == 0:
            lines.append("a line in nine or ten documents")
        if i % 2:
            lines += ["Accept cookies", f"Posted by {word(i, 3)} in category news of today", "}"]
        else:
            lines += [f"Posted by {word(i, 4)} at office number {i} of town", "{", "---"]
        if i % 50 == 0:
            lines += ["Introduction", "这是一段没有空格的很长的文字" * 4]
        rows.append((i, "\n".join(lines)))
    rows += [(1000 + i, "copied\nAccept cookies\nonly in the copies here") for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n}"), (None, "own\nAccept cookies"), (None, "own\nAccept cookies"), (5, "again with one id\nthird")]
    got = kept_lines(spark, rows)
    assert got == plain_lines(rows)
    texts = dict(got)
    assert texts[199] == f"own line {word(199)} {word(199, 1)} {word(199, 2)}\n}}"
    assert all("of the" not in texts[i] for i in range(1, 60) if i != 5) and "category" in texts[1] and "office" in texts[0]
    assert sum("category" in (t or "") or "office" in (t or "") for _, t in got) == 2
    assert "Introduction" in texts[150] and "文字" not in texts[150] and "only in the copies here" in texts[1029]


def test_a_line_in_nine_documents(spark):
    rows = [(i, f"{word(i)} {word(i, 1)} {word(i, 2)}\nthe same nine times") for i in range(9)]
    got = kept_lines(spark, rows)
    assert got == plain_lines(rows) and [("nine" in t) for _, t in got] == [True] + [False] * 8


def test_very_long_documents_are_looked_up_fast(spark):
    lines = "\n".join(f"{word(i)} {word(i, 1)} {word(i, 2)}" for i in range(100_000))
    start = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs(spark, [(1, lines), (2, lines + "\nmore of that")])).drop("text").collect()}
    assert got == {1: (100_000, 0), 2: (100_001, 100_000)} and time.time() - start < 60


def test_repeated_lines_by_documents(spark):
    """Shared blocks, rare repeats and a line that also stands in a large group of copies."""
    own = lambda i: " ".join(f"{c}{zlib.crc32(str(i).encode()):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for c in "qrst")
    block = "first of the block\nsecond of the block\nthird of the block\nfourth of the block"
    rows = [(i, f"{own(i)}\n{block}") for i in range(30)]
    rows += [(100 + i, f"{own(100 + i)}\nan ordinary line in two documents") for i in range(2)]
    rows += [(200 + i, f"{own(200 + i)}\na hot line of copies") for i in range(60)] + [(1000 + i, "copied\na hot line of copies\nonly in the copies") for i in range(400)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == own(i) for i in range(1, 30))
    assert got[100] == rows[30][1] and got[101] == own(101)
    assert got[200] == rows[32][1] and all(got[i] == own(i) for i in range(201, 260))
    assert all(got[1000 + i] == "copied\nonly in the copies" for i in range(400))


def test_repeated_lines_of_one_or_two_tokens(spark):
    own = lambda i: "".join("qrstuvwxyz"[int(c)] for c in str(i)) + " alone"
    passage = "这是一段没有空格的很长的文字" * 5
    rows = [(i, f"{own(i)}\nAnd ornd.\nLes.\n{passage}") for i in range(12)]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and all(got[i].text == own(i) and got[i].n_dropped == 3 for i in range(1, 12))
    numbers = [(i, f"{7 * i}\npage {i}\nShown {i} times to you") for i in range(12)] + [(50 + i, f"room 12\n{own(i)}\nborn in 1850 or in 1851") for i in range(2)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, numbers)).collect()}
    assert got[0] == numbers[0][1] and all(got[i] == f"{7 * i}\npage {i}" for i in range(1, 12))
    assert got[50] == numbers[12][1] and got[51] == f"room 12\n{own(1)}"  # a heading in two documents stays


def test_repeated_lines_odd_rows(spark):
    clash = odd(spark).selectExpr("*", "1 AS n_lines", "2 AS _drop2", "3 AS h", "4 AS t", "5 AS id")
    got = linededup.dedup_lines(clash).collect()
    assert len(got) == 9 and sum(r.text is None for r in got) == odd(spark).filter("text IS NULL").count()
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_held_out(spark):
    got = spark.range(50).withColumn("h", held_out("id")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_mixtures_of_many_languages():
    """Six of eight languages with letters of their own in one document: all six are in the set, in their proportions."""
    rng = np.random.default_rng(3)
    langs, width = 8, 200
    table = np.full((langs * width, langs), 1e-4)
    for j in range(langs):
        table[j * width:(j + 1) * width, j] = 1.0
    logs = np.log(table / table.sum(axis=0))
    shares = np.array([0.3, 0.2, 0.15, 0.15, 0.1, 0.1, 0, 0])
    drawn = np.concatenate([rng.integers(j * width, (j + 1) * width, int(4000 * s)) for j, s in enumerate(shares)])
    keys, counts = np.unique(drawn, return_counts=True)
    best = langid.mixtures(counts, np.zeros(len(keys), np.int64), logs[keys], 1, 3.0, 6)
    assert np.abs(best[0] - shares).max() < 0.01 and (best[0] > 0).sum() == 6
