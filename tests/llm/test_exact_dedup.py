"""Exact dedup against plain grouping, with honest and with colliding identifiers."""

import hashlib
import random
import re

import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import exact_dedup  # noqa: E402


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def table():
    rng = random.Random(1)
    texts = [" ".join(f"word{rng.randrange(50)}." for _ in range(rng.choice([1, 5, 400, 3000]))) for _ in range(30)]
    rows = [(k, rng.choice(texts)) for k in range(90)]
    rows += [(k + 100, t.replace(" ", "\n\t ")) for k, t in rows[:20]]
    return rows + [(300, None), (301, ""), (302, " "), (303, "\x0b"), (5, rows[5][1]), (None, texts[0]), (None, "alone"), (304, texts[1] + " ")]


@pytest.mark.parametrize("options", [{}, {"id_bits": 3}, {"least": 8, "most": 32}])
def test_groups_equal_plain_grouping(spark, options):
    rows = table()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, group_size int, chunks string")
    got = exact_dedup.dedup(docs, **options).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(normalised(t), []).append(d)
    want = []
    for d, t in rows:
        g = groups[normalised(t)]
        want.append((d, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(normalised(t).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    stay = {}
    for r in got:
        stay[r.text_sha256] = stay.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(stay.values()) == {1}
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


@pytest.mark.parametrize("most", [0, 1000])
def test_keep_with_clashing_columns_and_repeated_rows(spark, monkeypatch, most):
    from tracklake.llm import common, minhash

    monkeypatch.setattr(common.picked, "__defaults__", ("left_semi", "doc_id", most))
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, 1), (2, long.replace(" ", "\n"), 2), (2, "other", 3), (3, "other", 4), (4, "alone", 5), (4, "alone", 6), (None, "alone", 7), (None, "none", 8), (None, "none", 9), (5, None, 10), (6, "", 11)]
    columns = ["n_copies", "_id", "n", "_sha", "_text_sha", "_cuts", "kept", "row", "component_id", "bands"]
    docs = spark.createDataFrame([(d, t, *[k] * len(columns)) for d, t, k in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in columns))
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all(len({r[c] for c in columns}) == 1 for r in got)
    assert sorted((str(r.doc_id), r.text) for r in got if r.text) == sorted([("1", long), ("2", "other"), ("4", "alone"), ("None", "none")])
    assert [r.doc_id for r in got if not r.text] == [5]
    near = minhash.keep(docs)
    assert near.columns == docs.columns
    # one row of each id with words, null ids, and texts without words stay; ids with an earlier near copy go
    assert sorted((str(r.doc_id), r.text or "") for r in near.where("doc_id IS NULL OR text IS NULL OR text = '' OR doc_id = 1").collect()) == sorted([("1", long), ("None", "alone"), ("None", "none"), ("None", "none"), ("5", ""), ("6", "")])


def test_chunks_rebuild_the_text_and_empty_table(spark):
    rows = [(1, "Lorem ipsum dolor. " * 40 + "end"), (2, "é" * 5000), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    cut = df.select("text", F.array_join(F.regexp_extract_all("text", F.lit(exact_dedup.chunk_pattern(8, 32)), F.lit(0)), "").alias("again"))
    assert cut.where("text <> again").count() == 0
    assert exact_dedup.dedup(df.limit(0)).count() == 0
