"""The pipeline against a brute-force version of its stages on a small table."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tracklake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_exact_dedup import normalised  # noqa: E402
from test_minhash import brute  # noqa: E402
from test_quality import plain  # noqa: E402

from tracklake.llm import quality, secrets  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("house", "tree", "river", "stone", "bird", "cloud") for b in range(300)]
    rows, labels = [], []
    for k in range(160):
        w = [rng.choice(vocabulary) for _ in range(90)]
        if k % 8 == 0:
            w = [x.upper() + "!!" for x in w]
        if k % 10 == 3:
            w = rows[-1][1].split()
            w[5] = "edited"
        if k % 10 == 5:
            w = rows[-1][1].replace(" ", "\n").split("\n")
        if k % 7 == 0:
            w[20:20] = ["token", "=", '"0123456789abcdef0123456789abcdef"']
        text = " ".join(w)
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 0 if "!!" in text else 1, 0))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "short", "en", "s", 5), rows[1], rows[1]]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, dict((d, q) for d, q, _ in labels)


def test_stages_equal_brute_force(spark, folder):
    from tokenizers import Tokenizer

    from tracklake.llm import bpe

    path, rows, label = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == columns, name
    kept = now.collect()
    # quality: the base rules, then what the labels say, which this classifier can tell apart
    alive = [r for r in rows if plain(r[1])[0] >= 50 and label.get(r[0]) == 1]
    exact = {}
    for r in sorted(alive, key=lambda r: r[0]):
        exact.setdefault(normalised(r[1]), r)
    group = brute([(r[0], r[1]) for r in exact.values()])
    want = {r[0]: secrets.redacted(r[1]) for r in exact.values() if group[r[0]][1] == r[0]}
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(want.items())
    assert all("0123456789abcdef" not in r.text and r.n_chars == len(r.text) for r in kept)
    t = Tokenizer.from_file(bpe.vocabulary_path())
    packed = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted((d, len(t.encode(x, add_special_tokens=False).ids) + 1) for d, x in want.items())


def test_near_stage_takes_a_similarity_of_80_percent(spark):
    w = [f"w{k}" for k in range(104)]
    edited = w[:50] + ["edited"] + w[51:75] + ["edited"] + w[76:]  # 90 of 110 shingles, 0.82
    far = [f"x{k}" for k in range(104)]
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in enumerate((w, edited, far, far[:30] + ["a"] + far[31:60] + ["b"] + far[61:90] + ["c"] + far[91:]))]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    group = brute([r[:2] for r in rows], percent=80)
    assert [r[0] for r in rows if group[r[0]][1] == r[0]] == [0, 2, 3]


def test_every_stage_takes_an_empty_table(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0


def test_classifier_of_this_table_is_sharp(folder):
    _, rows, label = folder
    some = [r for r in rows if r[0] in label]
    m = quality.fit(quality.chunked(pa.array([r[1] for r in some], pa.large_string())), np.array([label[r[0]] for r in some]))
    p = quality.statistics(pa.array([r[1] for r in some], pa.large_string()), m)["probability"]
    assert all((x >= quality.LEAST_PROBABILITY) == (label[r[0]] == 1) for x, r in zip(p, some, strict=True))
