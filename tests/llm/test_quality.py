"""Quality rules: counts against plain loops, the classifier on held-out labels."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import quality  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, hit, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if times[x] > 1:
            hit |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


TEXTS = ["", None, "a a a a", "x y z x y z q", "l 1\nl 1\n \n\n l 1\nl 1", "é#$ \x85  x <b>|", "one\ttwo\x0bthree\x0cfour\rfive", "a b\n" * 40]


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [rng.choice(["house", "tree", "river", "stone", "bird", "cloud"]) + str(rng.randrange(50)) for _ in range(80)]
        out.append((k, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((k, int(not bad)))
    return out, labels


def test_counts_and_verdicts(spark):
    good, labels = rows()
    table = good + [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[3])]
    docs = spark.createDataFrame([(*r, "x") for r in table], "doc_id long, text string, kept string").repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] % 2 == 0] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.judge(docs, known).collect()
    want = Counter((d, *plain(t)) for d, t in table)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 400:
            assert r.kept == (not r.base_failed and dict(labels)[r.doc_id] == 1)
    assert quality.keep(docs, known).columns == docs.columns
    assert quality.keep(docs, known).count() == sum(r.kept for r in got)
    none = quality.judge(docs, known.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.judge(docs.limit(0), known).count() == 0


def test_margins_equal_the_feature_matrix():
    good, labels = rows(100)
    texts, y = pa.array([t for _, t in good], pa.large_string()), np.array([q for _, q in labels])
    m = quality.fit(quality.chunked(texts), y)
    r, s, v = quality.features(texts)
    at, words = quality.words_of(texts, lower=False)
    h, codes, names = quality.hashes_of(words)
    assert np.allclose(m.margins(h, at, codes, names, 100), np.bincount(r, m.weights[s] * v, 100) + m.bias, atol=1e-3)


class _Tasks:
    """Stands for a table; gives the work of a task itself."""

    schema = None

    def mapInArrow(self, work, schema):  # noqa: N802
        return work


def test_memory_of_a_task_does_not_follow_its_batch(monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"{rng.choice('abcdefgh')}{k}" for k in range(5000)]
    texts = [" ".join(rng.choices(vocabulary, k=600)) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(quality, "train", lambda *_: quality.Model(np.zeros(1 << quality.BITS, np.float32), 1.0, 1.0, 0.0))
    work = quality.keep(_Tasks(), None)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in work([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 40e6  # 18 MB; 73 MB in steps of 4 MB
