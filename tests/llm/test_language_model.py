"""Language-model scores against a plain dictionary model."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import language_model as lm  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, order, mu):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    tokens = lambda t: WORD.findall((t or "").translate(ASCII)) + ["</s> "]
    counts, docs = Counter(), 0
    for d, t in rows:
        if not held(d):
            docs += 1
            w = ["<s> "] * (order - 1) + tokens(t)
            for i in range(order - 1, len(w)):
                for k in range(order):
                    counts[tuple(w[i - k : i + 1])] += 1
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)
    context = Counter()
    for g, c in counts.items():
        context[g[:-1]] += c
    out = []
    for d, t in rows:
        w = ["<s> "] * (order - 1) + tokens(t)
        base = score = known = 0
        for i in range(order - 1, len(w)):
            p = (counts[(w[i],)] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            known += counts[(w[i],)] > 0
            for k in range(1, order):
                if c := context[tuple(w[i - k : i])]:
                    p = (counts[tuple(w[i - k : i + 1])] + mu * p) / (c + mu)
            score += math.log10(p)
        out.append((d, held(d), len(w) - order + 1, known, n, round(base, 6), round(score, 6)))
    return out


def table(n=150):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["The", "cat", "sat", "on", "mat", f"w{rng.randrange(60)}", "É"]) for _ in range(rng.randrange(25)))) for k in range(n)]
    return rows + [(None, "the cat"), (7, "the cat"), (7, "the cat"), (900, None), (901, ""), (902, "\x0b ")]


@pytest.mark.parametrize("order,size", [(1, 1 << 20), (2, 1 << 20), (2, 200), (3, 500), (4, 1 << 20)])
def test_scores_equal_the_plain_model(spark, order, size):
    rows = table()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = [(*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, order=order, mu=3.0, block_bytes=size).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, order, 3.0), key=str)


def test_automaton_has_states_and_failure_arcs():
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["a b c", "a b d", "x"], pa.large_string())
    t = lm.Tokens([1, 2, 10], texts, 3)
    found = lm.uniques(t)
    totals = [np.bincount(back[t.at < 2], minlength=len(keys)).astype(float) for keys, back in found]  # the first two texts train
    m = lm.Automaton(t, found, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), 2, 3.0)
    tokens = found[0][1]
    a, b, c, end = tokens[0], tokens[1], tokens[2], tokens[3]
    # states: empty, two marks, then a b c d, then the pairs of training texts that do not end them
    assert len(m.fail) == 3 + 4 + 4 and m.start == 2
    arc = dict(zip(m.key.tolist(), zip(m.to.tolist(), m.log.tolist()), strict=True))
    state = m.start
    for x in (a, b, c, end):
        assert state * m.tokens + x in arc
        state = arc[state * m.tokens + x][0]
    # "a b" fails to "b", which fails to the empty context; weights are those of interpolation
    ab = arc[arc[m.start * m.tokens + a][0] * m.tokens + b][0]
    only_b = arc[0 * m.tokens + b][0]
    assert m.fail[ab] == only_b and m.fail[only_b] == 0 and m.backoff[ab] == pytest.approx(math.log10(3 / 5))
    # every state's probabilities over the vocabulary and one unknown token sum to one
    known = np.flatnonzero(totals[0] > 0)
    for s in range(len(m.fail)):
        total = 0.0
        for x in [*known, tokens[t.at == 2][0]]:
            at, log = s, 0.0
            while at * m.tokens + x not in arc:
                at, log = m.fail[at], log + m.backoff[at]
            total += 10 ** (log + arc[at * m.tokens + x][1])
        assert total == pytest.approx(1)


def test_empty_table_and_packing_of_numbers(spark):
    import numpy as np

    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    x = np.unique(np.random.default_rng(0).integers(0, 2**64, 999, dtype=np.uint64))
    assert (lm.unrising(lm.rising(x)) == x).all() and (lm.unplaned(lm.planes(x)) == x).all()
