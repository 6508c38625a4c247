"""Packing against the tokenizers library and the lower bound."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import bpe, packing  # noqa: E402


def check(docs, capacity=2048, **options):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    rows = packing.pack(docs, capacity=capacity, **options).collect()
    want = sorted((r.doc_id or -1, t.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect())
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    made = []
    for d, ids in want:
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        made += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(made)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), sum(len(ids) for _, ids in want)


def test_pieces_and_bins(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["the", "cat", "zyx", "über"]) for _ in range(rng.choice([3, 20, 60, 300])))) for k in range(400)]
    rows += [(None, None), (500, ""), (501, "a " * 700), (501, "a " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    bins, tokens = check(docs, capacity=128, group=50)
    assert bins <= 1.05 * tokens / 128 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, t = Tokenizer.from_file(bpe.vocabulary_path()), packing.Tokenizer(bpe.vocabulary_path())
    assert t.fast is not None
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the", "ing", " ", "  ", "\n", "\t", "é", "日本", "'s", "'T", "1", "23", ".", "\x85", "\u3000", "👍🏽", "<|endoftext|>", "\u0301"]) for _ in range(40)) for _ in range(2000)]
    texts += ["", "a" * 100_000, "ab " * 50_000, " " * 2_000_000 + "x"]  # the last is too much white space for the fast pattern
    for x in texts:
        assert t.ids(x).tolist() == library.encode(x, add_special_tokens=False).ids
    # every token comes back alone from its own bytes, which makes merging by tokens' ranks the library's order
    v = bpe.vocabulary(bpe.vocabulary_path())
    words = [w for w in v.ids if w.decode("utf-8", "replace") not in v.special]
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ids, width = v.merge_many(data, np.cumsum(size) - size, size)
    assert (width == 1).all() and ids.tolist() == [v.ids[w] for w in words]


def test_best_fit_fills_exactly():
    lengths = np.array([60, 50, 40, 30, 20, 10, 100, 100])
    place, offset, fill = packing.best_fit(lengths, 100)
    assert sorted(fill.tolist(), reverse=True)[:2] == [100, 100]
    assert len(fill) == 5 and fill.sum() == lengths.sum()
    assert len(packing.best_fit(np.zeros(0, np.int64))[2]) == 0
