"""Filter audit against loops over documents and orders, and its SQL; hashes that meet."""

import itertools
import random
import re

import duckdb
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import audit  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t), d is not None and first[t] < d)) if x}
        docs.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = [x for x in docs if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                failing = [x for x in docs if x[0] == part and f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def table(seed=1, n=250):
    rng = random.Random(seed)
    texts = ["", " ", "a", " a\n", "\u00a0", "b", "#", "UPPER CASE", "é" * 70, "é" * 69 + "e", "x" * 600, "x" * 599 + "y", "x" * 64 + "y" * 536] + [" ".join(f"{rng.choice('aAbB#')}{rng.randrange(k)}" for _ in range(rng.randrange(260))) for k in (3, 50, 4000, 4000, 90000)]
    rows = [(k, rng.choice(texts) + rng.choice(["", "", " z"]), rng.choice(["en", "de", None, ""])) for k in range(n)]
    rows += [(3, texts[5], "en"), (3, texts[5], "en"), (None, texts[5], "en"), (None, None, None), (7, "again", "fr"), (900, "Long word %d " * 25_000, "en"), (901, "Long word %d " * 25_000, "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, n, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    return rows, labels


def got(df):
    return sorted((r.part, r.filter_order, r.step, *(r[c] for c in audit.COUNTS)) for r in df.collect())


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, class string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("heavy,lot,bits", [(10_000, 1000, (64,)), (3, 2, (64,)), (10_000, 3, (1, 64))])
def test_equals_loops(spark, monkeypatch, heavy, lot, bits):
    monkeypatch.setattr(audit, "HEAVY", heavy)
    monkeypatch.setattr(audit, "LOT", lot)
    rows, labels = table()
    assert got(audit.audit(*frames(spark, rows, labels), bits)) == brute(rows, labels)


def test_sql_agrees(spark, tmp_path):
    rows, labels = table(5, 120)
    docs, marks = frames(spark, rows, labels)
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/d")
    marks.write.parquet(f"{tmp_path}/l")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    c.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/l/*.parquet'")
    assert sorted(c.execute(f"SELECT part, filter_order, step, {', '.join(audit.COUNTS)} FROM ({audit.ORACLE})").fetchall()) == brute(rows, labels)


def test_hashes_that_always_meet_and_empty_tables(spark):
    docs, labels = frames(spark, [(1, "aa", "en"), (2, "bb", "en")], [])
    with pytest.raises(RuntimeError):
        audit.audit(docs, labels, (0, 0))
    assert audit.audit(docs.limit(0), labels).count() == 0


def test_refinement_drops_singletons(spark):
    rows = [(1, "a" * 100, "x"), (2, "a" * 100, "x"), (3, "a" * 99 + "b", "x"), (4, "a", "x"), (5, "b" * 100, "x"), (6, None, "x")]
    docs, _ = frames(spark, rows, [])
    assert sorted(r.doc_id for r in audit.surviving(audit.judged(docs), 6).collect()) == [1, 2]
