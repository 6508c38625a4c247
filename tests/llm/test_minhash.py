"""Near-duplicate documents against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import minhash  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    """doc_id: (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = {}
    for d, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(d)
    for d, s in sets.items():
        k = {}
        for x in s:
            for e in at[x]:
                if e < d:
                    k[e] = k.get(e, 0) + 1
        for e, both in k.items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def table(n_groups, size, words, edits, seed=5):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(n_groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((k, " ".join(t)))
            k += 1
    return rows


@pytest.mark.parametrize("rounds,block", [(0, 7), (2, 512), (1, 40)])
def test_components_equal_brute_force(spark, rounds, block):
    rows = table(6, 40, 150, 8) + [(1000, "Only Four words Here"), (1001, "only four\twords here"), (1002, ""), (1003, None), (1004, "one"), (1005, " \n ")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", None), (3, None, "z"), (2, "A B C D E F", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bands string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (3, 3, True), (2, 1, False)], key=str)
    kept = minhash.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signature_is_unbiased_and_steadier_than_plain_minhash():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
        a, b = np.sort(x[:200]), np.sort(x[100:])
        sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 200, 400]))
        errors.append((sig[0] == sig[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.045


def test_shingle_sets_count():
    texts = ["a b c d e f g", "a b c d e a b c d e", "", "x y", "é\x0bÉ \x85"]
    s, bounds = minhash.shingle_sets(pa.array(texts, pa.large_string()))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]


def rowwise(rows, percent=85):
    """(component_id of each row, rows that stay) by loops over rows, ids apart from texts."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    takes = [d is not None and bool(s) for (d, _), s in zip(rows, sets)]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if takes[i] and takes[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    least, first = {}, {}
    for i, (d, _) in enumerate(rows):
        if takes[i]:
            least[root(i)] = min(least.get(root(i), d), d)
    stay = sum(not t for t in takes) + len(least)
    for i, (d, t) in enumerate(rows):
        if takes[i] and d == least[root(i)]:
            first.setdefault(root(i), []).append((d, t))
    return [least[root(i)] if takes[i] else d for i, (d, _) in enumerate(rows)], stay, list(first.values())


@pytest.mark.parametrize("seed", range(3))
def test_repeated_ids_with_other_texts(spark, seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [words(60) for _ in range(6)]
    near = lambda t: " ".join(t[:-1] + [f"x{rng.randrange(10**6)}"])
    rows = [(rng.randrange(1, 12) if rng.random() < 0.95 else None, rng.choice([" ".join(t), near(t), "", "few words"])) for t in (rng.choice(texts) for _ in range(60))]
    if seed == 0:
        a, b, c = (" ".join(t) for t in texts[:3])
        rows = [(1, a), (1, b), (2, b), (3, a), (4, c)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, f1 int")
    want, stay, firsts = rowwise(rows)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((d, len(shingles(t)), w) for (d, t), w in zip(rows, want)), key=str)
    kept = minhash.keep(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == stay
    for group in firsts:
        assert sum(x in group for x in left) == 1 or len({t for _, t in group}) > 1
    if seed == 0:
        assert sorted(left) == sorted([(1, a), (1, b), (4, c)])


def test_a_block_holds_each_member_once(spark, monkeypatch):
    plain = minhash._connect

    def once(percent):
        work = plain(percent)

        def checked(pdf):
            assert pdf.id.is_unique  # else sets move more than once to one block
            return work(pdf)

        return checked

    monkeypatch.setattr(minhash, "_connect", once)
    rows = table(2, 60, 60, 9)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1, block=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_every_pair_of_two_components_meets_in_a_block(spark):
    comp = {k: k % 3 if k < 30 else 50 + k for k in range(40)}  # 0 is the largest
    rows = [(7, k, 9, c, 0, 3, 2) for k, c in comp.items()]
    got = minhash.dealt(spark.createDataFrame(rows, "bucket long, id long, n long, comp long, main long, blocks int, minors int")).collect()
    assert len({(r.i, r.j, r.id) for r in got}) == len(got) == sum(2 if c == 0 else 4 for c in comp.values())
    block = {}
    for r in got:
        block.setdefault((r.i, r.j), []).append(r)
    met = {(x.id, y.id) for members in block.values() for x in members if x.minor for y in members if x.comp != y.comp}
    assert met == {(x, y) for x in comp for y in comp if comp[x] != 0 and comp[x] != comp[y]}


def test_labels_are_merged_not_found_anew(spark, monkeypatch):
    given, plain = [], minhash.components

    def seen(edges, *args, **more):
        given.append({(min(r.a, r.b), max(r.a, r.b)) for r in edges.collect()})
        return plain(edges, *args, **more)

    monkeypatch.setattr(minhash, "components", seen)
    rows = table(2, 40, 150, 8)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1, block=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(given) > 1 and len(set.union(*given)) == sum(map(len, given))  # components() gets no link twice
