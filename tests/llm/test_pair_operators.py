"""Similarity join, decontamination, components, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from compare import check, duck
from proofline.llm import decontam, jaccard
from proofline.llm.graph import components

from .test_text_operators import docs, odd


def plain_components(rows, k, num, den):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    partners = Counter()
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    partners.update((a, b))
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), partners[i]) for i in ids}


def joined(spark, rows, num):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_documents(docs(spark, rows), 4, num, 100).collect()}


def corpus(seed, groups, size, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            if rng.random() < 0.2:
                words += base[:rng.randint(1, 6)]
            rows.append((len(rows), " ".join(words).title() if rng.random() < 0.2 else " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell,heap", [(1_000_000, 1024), (60, 0), (1, 1024)])
def test_join_matches_brute_force(spark, monkeypatch, cell, heap):
    """Whole homes, homes cut into cells and waves, and a task per node; the heap and the array."""
    monkeypatch.setattr(jaccard, "CELL_SHINGLES", cell)
    monkeypatch.setattr(jaccard, "HEAP_ENTRIES", heap)
    rows = corpus(cell, 25, 9, 3) + [(10_000 + i, t) for i, (_, t) in enumerate(corpus(7, 1, 60, 2) if cell == 60 else [])]
    assert joined(spark, rows, 85) == plain_components(rows, 4, 85, 100)


def test_large_group_in_cells(spark, monkeypatch):
    """110 near copies of one text, exact copies among them, in cells of a few: every link of every document counts once."""
    monkeypatch.setattr(jaccard, "CELL_SHINGLES", 600)
    rng = random.Random(3)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(110):
        words = list(base) + [f"tail{j}" for j in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = rng.choice(["p", "q", "r", "s"])
        rows.append((i, " ".join(words)))
    for num in (85, 70):
        assert joined(spark, rows, num) == plain_components(rows, 4, num, 100)


def templated(n, seed=5):
    """Texts of eight slots between fixed words, variants from a pool: many shared rare shingles, hardly a link."""
    rng = random.Random(seed)
    pool = [[" ".join(f"s{k}v{v}w{j}" for j in range(6)) for v in range(40)] for k in range(8)]
    return [(i, " ".join(f"fixed{k} and {rng.choice(pool[k])}" for k in range(8))) for i in range(n)]


def test_templated_texts(spark, monkeypatch):
    """Shared prefix shingles chain all texts; only the tasks of shared lists are searched, and the result is exact."""
    monkeypatch.setattr(jaccard, "CELL_SHINGLES", 2000)
    rows = templated(300)
    rows += [(1000 + i, t + " one more") for i, t in rows[:20]]
    assert joined(spark, rows, 85) == plain_components(rows, 4, 85, 100)


def test_many_ranges(spark):
    """More ranges than 16 bits can name: the range takes further bits of the hash."""
    rows = corpus(11, 6, 5, 2)
    sets = {ranges: {(r.node, r.n, len(r["keys"]), r.n_prefix) for r in jaccard.candidate_sets(
        docs(spark, rows).repartition(2), jaccard.np.zeros(0, jaccard.np.uint64), ranges, 4, 85, 100).collect()} for ranges in (16, 1 << 20)}
    assert sets[16] and sets[16] == sets[1 << 20]


def test_join_twin(spark, sf):
    ok, note = check(spark, duck(sf), "op7_divide_skip", sf)
    assert ok, note


def test_join_odd_rows(spark):
    clash = odd(spark).selectExpr("*", "1 AS node", "2 AS component_id", "3 AS n_shingles")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(clash, 5).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (4, 2, 4), (None, 2, 4), (5, 1, 5), (6, 1, 6), (7, 1, 7)], key=str)
    assert jaccard.similar_documents(docs(spark, [])).count() == 0
    assert jaccard.similar_documents(docs(spark, [(1, None), (2, " ")])).filter("component_id = doc_id").count() == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def plain_leaks(rows, items, k=5, threshold=0.8):
    def shingles(words):
        return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])

    out = {}
    for d, text in rows:
        words = words_of(text)
        for i, item in items:
            own = words_of(item)
            if not own:
                continue
            width = len(own)
            windows = [words[s:s + width] for s in range(len(words) - width + 1)] or ([words] if len(words) >= k else [])
            best = max(((sum((a & b).values()) / sum((a | b).values()), -s) for s, w in enumerate(windows) if w
                        for a, b in [(Counter(shingles(w)), Counter(shingles(own)))] if width >= k or len(w) == width), default=(0, 0))
            if best[0] >= threshold:
                out[d, i] = (round(best[0], 9), -best[1])
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 12, 20, 31, 44, 60])))) for i in range(40)] + [(99, ""), (98, None), (7, "a b c d e f g h a b c d e f g h")]
    rows = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            leak = rng.choice(items[:40])[1].split()
            if d % 4 == 1 and len(leak) > 30:
                leak[rng.randrange(len(leak))] = "changed"
            if d % 8 == 3:
                leak = leak[1:]
            at = rng.randint(0, len(words))
            words[at:at] = leak
        rows.append((d, ", ".join(words).title() if d % 3 == 0 else "\n".join(words)))
    rows += [(200, None), (201, ""), (202, "a b c d e f g h a b c d e f g h"), (203, "A b c d e f g h a b c d e f g")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontam.leaks(docs(spark, rows), table).collect()}
    want = plain_leaks(rows, items)
    assert got == want and (202, 7) in got and (203, 7) in got


def test_leaks_of_items_of_all_lengths():
    """Every item has windows of its own length, whichever other items there are."""
    rng = random.Random(4)
    word = lambda: f"w{rng.getrandbits(40):x}"
    texts = [" ".join(word() for _ in range(n)) for n in [*[15] * 80, *range(15, 400, 6), 500, 750, 1200, 2500, 5000]]
    rows = [" ".join([*(word() for _ in range(30)), t, *(word() for _ in range(30))]) for t in texts]
    items = decontam.Items(list(range(len(texts))), texts, 5, 15)
    assert items.leaks(pa.array(rows), 0.8) == [[(i, 1.0, 30, len(t.split()))] for i, t in enumerate(texts)]
    alone = decontam.Items([3], texts[3:4], 5, 15)
    assert alone.leaks(pa.array(rows[3:4]), 0.8) == items.leaks(pa.array(rows[3:4]), 0.8)


def test_many_items_of_one_length():
    """More items of a size than any crossover: the block tables against a plain search of windows."""
    rng = random.Random(12)
    vocabulary = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(300)]
    rows = []
    for d in range(16):
        leak = items[rng.randrange(300)][1].split()
        leak[rng.choice([0, 1, 38, 39])] = "changed"
        rows.append((d, " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 20))] + leak[:40 - d % 2] + [rng.choice(vocabulary) for _ in range(9)])))
    found = decontam.Items([i for i, _ in items], [t for _, t in items], 5, 15).leaks(pa.array([t for _, t in rows]), 0.8)
    got = {(d, i): (round(v, 9), s) for d, hits in enumerate(found) for i, v, s, _ in hits}
    assert got == plain_leaks(rows, items) and len(got) >= 16


def test_block_tables_find_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 30)) for _ in range(250)]
    items = decontam.Items(list(range(250)), texts, 5, 15)
    (_, tables, members), = items.classes
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 25, 4000)], np.uint64)
    prints = items.prints[rng.integers(0, 250, 4000)] ^ flips
    at, item = items._candidates(prints, tables, members)
    want = np.bitwise_count(prints[:, None] ^ items.prints[None, :]) <= 15
    assert {*zip(at.tolist(), item.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(want)))}


def test_fingerprints():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 2**63, 700).astype(np.uint64)
    for size in (1, 2, 31, 254, 255, 256, 600):
        got = decontam._fingerprints(h, size)
        for s in (0, len(got) - 1):
            bits = [(int(x) >> b) & 1 for b in range(64) for x in h[s:s + size]]
            want = sum(1 << b for b in range(64) if 2 * sum(bits[b * size:(b + 1) * size]) > size)
            assert int(got[s]) == want


def test_leaks_in_item_blocks_and_odd_rows(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta gamma delta epsilon zeta eta theta iota kappa{i}") for i in range(9)] + [(None, "x y z")], "item_id bigint, text string")
    rows = docs(spark, [(i, f"see alpha{i} beta gamma, delta epsilon zeta eta theta iota kappa{i}!") for i in range(9)])
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    assert sorted((r.doc_id, r.item_id, r.start_word) for r in decontam.leaks(rows, items).collect()) == [(i, i, 1) for i in range(9)]
    clash = odd(spark).selectExpr("*", "1 AS leaks", "2 AS _row", "3 AS _text", "4 AS item_id")
    got = decontam.with_leaks(clash, items)
    assert got.count() == 9 and got.filter("size(leaks) > 0").count() == 0 and "_row" in got.columns
    assert decontam.leaks(rows, items.filter("false")).count() == 0 and decontam.leaks(docs(spark, []), items).count() == 0
