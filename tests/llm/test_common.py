"""Shared helpers."""

import pyarrow as pa
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import common  # noqa: E402


def test_words_of_slices_of_a_batch():
    texts = [f"Word{k} É {'x' * (k % 7)}\tb\x0b{k} " for k in range(9000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for lo in range(0, 9000, 2000):
        at, words = common.words_of(common.texts_of(batch.slice(lo, 2000)))
        want = [(k, w) for k, t in enumerate(texts[lo : lo + 2000]) for w in t.encode().lower().split()]
        assert list(zip(at.tolist(), words.cast(pa.large_binary()).to_pylist(), strict=True)) == want
        assert len(common.hashes_of(words)[0]) == len(want)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_star_take_two_rounds(spark, monkeypatch):
    written, plain = [], common.save
    monkeypatch.setattr(common, "save", lambda df, name="table": (written.append(name), plain(df, name))[1])
    edges = spark.range(2000).selectExpr("1000 AS a", "id AS b")
    got = common.components(edges)
    assert got.count() == 2000 and got.where("component <> 0").isEmpty()
    assert written.count("label") <= 2
