"""Source mixing against plain loops, its SQL, and the law of weighted draws."""

import hashlib
import math
import random
import re

import duckdb
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import mixing  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights, shares=(3, 1, 2), percent=150, most=2):
    """(doc_id, size, source_size, target, taken) by plain loops."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = {}
    for (_, _, s), n in zip(rows, size):
        total[s] = total.get(s, 0) + n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in total else [])
    share = {s: shares[k % len(shares)] for k, s in enumerate(order)}
    target, rest, live = dict.fromkeys(order, 0.0), percent * sum(size) / 100, list(order)
    while live and rest > 1e-9:
        each = rest / sum(share[s] for s in live)
        rest = 0.0
        for s in live:
            target[s] += each * share[s]
        for s in live:
            rest += max(0.0, target[s] - most * total[s])
            target[s] = min(target[s], most * total[s])
        live = [s for s in live if target[s] < most * total[s]]
    out = []
    for s in order:
        def key(i):
            name = str(rows[i][0]) if rows[i][0] is not None else "text:" + hashlib.md5((rows[i][1] or "").encode()).hexdigest()
            u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / weights.get(rows[i][0], 1.0), size[i]

        epochs = int(target[s] / total[s] + 1e-12) if total[s] else 0
        left = round(target[s] + 1e-9) - epochs * total[s]
        for i in sorted((i for i in range(len(rows)) if rows[i][2] == s), key=key):
            part = max(0, min(size[i], left))
            left -= part
            out.append((rows[i][0], size[i], total[s], round(target[s], 6), epochs * size[i] + part))
    return out


def table(seed=2, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(["b"] * 12 + ["a", "ä", "z\U0001f600", "￮", "", None])
        rows.append((k, " \t".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 7, 30]))) + rng.choice(["", "\n"]), source))
    return rows + [(3, "again here", "a"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (None, "no id", "a"), (None, "no id", "a"), (None, None, None), (900, "\x1c x", "a"), (901, "long word " * 25_000, "c")]


def shown(r):
    return (r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken)


def test_plan_equals_loops_and_sql(spark, tmp_path):
    rows = table()
    rng = random.Random(1)
    labels = [(d, rng.choice([0, 1, None])) for d, _, _ in rows[:200]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, key string")
    weights = mixing.quality_weights(spark.createDataFrame(labels, "doc_id long, quality int"))
    got = mixing.mix(docs, weights).collect()
    known = {d: {1: 2.0, 0: 0.5}.get(q, 1.0) for d, q in labels}
    assert sorted(map(shown, got), key=str) == sorted(brute(rows, known), key=str)
    assert all(r.taken <= 2 * r["size"] for r in got)
    docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}).to_parquet(f"{tmp_path}/d.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT doc_id, text, source FROM '{tmp_path}/d.parquet'")
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER)")
    c.executemany("INSERT INTO labels VALUES (?, ?)", labels)
    want = c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()
    assert sorted(map(shown, got), key=str) == sorted(((d, s, z, round(t, 6), k) for d, s, z, t, k in want), key=str)


@pytest.mark.parametrize("shares,percent,most", [((3, 1, 2), 150, 2), ((1,), 40, 1), ((5, 1), 300, 3)])
def test_other_shares_and_reruns(spark, shares, percent, most):
    rows = [r for r in table(7, 150) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(shown, mixing.mix(docs, None, shares, percent, most).collect()), key=str)
    two = sorted(map(shown, mixing.mix(docs.repartition(7), None, shares, percent, most).collect()), key=str)
    assert one == two == sorted(brute(rows, {}, shares, percent, most), key=str)


def test_draws_follow_weights(spark):
    docs = spark.createDataFrame([(k, "one", "s") for k in range(4000)] + [(k, "one two three four", "t") for k in range(4000, 8000)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(k, 4.0 if k % 2 else 1.0) for k in range(8000)], "doc_id long, weight double")
    got = mixing.mix(docs, weights, (1,), 20, 1).where("source = 't' AND taken > 0").collect()
    heavy = sum(r.doc_id % 2 for r in got) / len(got)
    # a tenth of all words of 't' is 500 of 4000 documents: drawn at rates near 4 to 1
    assert 0.72 < heavy < 0.84


def test_mixed_gives_the_words_of_the_plan(spark):
    rows = [(k, f"a{k} \n b  c d\te ", s) for k, s in enumerate("xxyyyyyz")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, taken int")
    plan = mixing.mix(docs)
    out = mixing.mixed(docs, plan)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert rows[r.doc_id][1].startswith(r.text) and r.taken == r.doc_id
    assert words == {r.doc_id: r.taken for r in plan.collect() if r.taken}


def test_empty_tables_and_tables_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0, 0.0, 0)] * 2
    assert mixing.mix(docs.limit(0), mixing.quality_weights(spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, percent=201)
