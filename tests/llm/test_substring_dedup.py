"""Repeated passages: every planted one is met, clean documents are left alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import substring_dedup as sd  # noqa: E402


def words(rng, n):
    return [f"w{rng.randrange(10**5)}" for _ in range(n)]


def test_passages_are_met_and_cut(spark):
    rng = random.Random(3)
    rows, planted = [], {}
    passages = [words(rng, 50 + 3 * k) for k in range(12)]
    for k in range(120):
        w = words(rng, rng.randrange(30, 200))
        if k < 60:
            p = passages[k % 12]
            at = rng.randrange(len(w))
            w[at:at] = p
            planted[k] = (at, at + len(p))
        rows.append((k, " ".join(w) if k % 2 else "\n".join(w), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (None, rows[0][1], "x"), (502, "of " * 300, "x"), (503, "of " * 300, "x"), (504, "short text", "x"), (504, "short text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sd.stretches(docs).collect()
    assert {r.doc_id for r in got} == set(planted)
    for r in got:
        a, b = planted[r.doc_id]
        assert a - 1 <= r.start < r.end <= b + 1 and r.removed == (r.doc_id >= 12) and r.first_doc == r.doc_id % 12
    left = {r.doc_id: r.text for r in sd.remove(docs).collect() if r.doc_id is not None}
    for d, t, _ in rows:
        if d is not None and d not in range(12, 60):
            assert left[d] == t
    assert all(len(left[d].split()) < len(rows[d][1].split()) for d in range(12, 60))
    assert sd.stretches(docs.limit(0)).count() == 0


def test_whole_passages_are_in_the_stretches(spark):
    rng = random.Random(8)
    rows, planted = [], {}
    for n, size in enumerate([50, 51, 55, 60, 64, 75, 100, 200] * 4):
        p = words(rng, size)
        for k in range(3):
            w = words(rng, rng.randrange(20, 90))
            at = rng.randrange(len(w))
            w[at:at] = p
            planted[3 * n + k] = (at, at + size)
            rows.append((3 * n + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.stretches(docs).collect()
    assert sorted((r.doc_id, r.removed) for r in got) == [(d, d % 3 > 0) for d in sorted(planted)]
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    sets = [shingles(t) for _, t in rows]
    for r in got:  # lines that are alike as a whole go as a whole
        whole = any(alike(sets[r.doc_id], sets[e]) for e in range(r.doc_id // 3 * 3, r.doc_id // 3 * 3 + 3) if e != r.doc_id)
        assert (r.start, r.end) == ((0, len(rows[r.doc_id][1].split())) if whole else planted[r.doc_id])
        assert r.first_doc == r.doc_id // 3 * 3 and r.first_word in (0, planted[r.first_doc][0])


def shingles(line):
    w = line.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_lines_are_linked_as_brute_force_links_them(spark):
    """All pairs of lines at a Jaccard similarity of 0.8: components, the first document of each, and recall near the threshold."""
    rng = random.Random(4)
    rows, lines = [], []
    for d in range(160):
        own = []
        for k in range(4):
            if lines and rng.random() < 0.5:
                line = rng.choice(lines)[1].split()
                for _ in range(rng.randrange(4)):  # every edit costs up to ten shingles of the union
                    line[rng.randrange(len(line))] = f"e{rng.randrange(10**5)}"
                line = " ".join(line)
            else:
                line = " ".join(words(rng, rng.randrange(21, 150)))
            own.append(line)
        rows.append((d, "\n".join(own)))
        lines += [(d, line) for line in own]
    sets = [shingles(line) for _, line in lines]
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(both := sets[i] & sets[j]) >= 80 * (len(sets[i]) + len(sets[j]) - len(both)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    docs_of = {}
    for i, (d, _) in enumerate(lines):
        docs_of.setdefault(root(i), set()).add(d)
    want = {}
    place = {}
    for i, (d, line) in enumerate(lines):
        at = place.get(d, 0)
        place[d] = at + len(line.split())
        if len(docs_of[root(i)]) > 1:
            want[d, at] = min(docs_of[root(i)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.place): r.first_doc for r in sd.repeated(docs).where("NOT seed").collect()}
    assert len(want) > 200 and got == want


@pytest.mark.parametrize("places", [sd.PLACES, 0])
def test_any_doc_id_and_clashing_columns(spark, monkeypatch, places):
    monkeypatch.setattr(sd, "PLACES", places)
    rng = random.Random(12)
    p = words(rng, 60)
    ids = [2**62, -(2**62), 2**62 + 1]
    rows = [(d, " ".join(words(rng, 30) + p + words(rng, 30)), k, "x", 1, 2) for k, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cuts int, _id string, n int, place int")
    got = {r.doc_id: (r.start, r.end, r.removed, r.first_doc) for r in sd.stretches(docs).collect()}
    assert got == {d: (30, 90, d > 0, -(2**62)) for d in ids}
    left = sd.remove(docs)
    assert left.columns == docs.columns
    assert {(r.doc_id, len(r.text.split()), r._cuts, r._id, r.n, r.place) for r in left.collect()} == {(d, 120 if d < 0 else 60, k, "x", 1, 2) for k, d in enumerate(ids)}


def seeds_of(text):
    w = sd.Words(pa.array([text], pa.large_string()))
    first, f, g = sd.seeds(w)
    return first, list(zip(f.tolist(), g.tolist()))


def test_every_text_has_a_seed():
    rng = random.Random(9)
    for n in range(20, 60):
        texts = pa.array([" ".join(words(rng, n)) for _ in range(40)], pa.large_string())
        w = sd.Words(texts)
        assert set(w.at[sd.seeds(w)[0]].tolist()) == set(range(40)), n
    for period in range(2, 9):
        assert len(seeds_of(" ".join(words(rng, period) * 30))[0]), period


def test_long_texts_and_many_steps(spark):
    rng = random.Random(13)
    p = words(rng, 25_000)
    rows = [(0, "\n".join(p)), (1, "\n".join(words(rng, 50) + p[:24_000])), (2, " ".join(words(rng, 20_000)))]
    got = {(r.doc_id, r.start, r.end, r.removed) for r in sd.stretches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 0, 24_000, False), (1, 50, 24_050, True)}


def test_short_copies_and_repeated_phrases_are_removed(spark):
    rng = random.Random(10)
    texts = [" ".join(words(rng, n)) for n in range(35, 50)] + [" ".join(words(rng, n) * 40) for n in range(2, 8)]
    docs = spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(2 * len(texts))], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end) for r in sd.stretches(docs).where("removed").collect()}
    assert got == {(k + len(texts), 0, len(t.split())) for k, t in enumerate(texts)}


def test_seeds_of_any_place_agree():
    rng = random.Random(5)
    for n in (39, 40, 50, 51, 64, 90):
        p = words(rng, n)
        keys = []
        for _ in range(2):
            head = words(rng, rng.randrange(60))
            first, found = seeds_of(" ".join(head + p + words(rng, rng.randrange(60))))
            keys.append({k for k, a in zip(found, first, strict=True) if a >= len(head) and a + sd.LEAST <= len(head) + n})
        assert keys[0] & keys[1]
    x = np.array([5, 3, 9, 1, 7])
    assert sd.sliding(x, 3, True).tolist() == [3, 1, 1] and sd.sliding(x, 4, False).tolist() == [9, 9]
