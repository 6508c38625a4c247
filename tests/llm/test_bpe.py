"""BPE against the tokenizers library."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import bpe  # noqa: E402

TEXTS = ["", None, "a<|endoftext|>b <|endoftext|>", "  x\n\n y\t\t", "日本語テキスト👍🏽 é  z", "a" * 300 + "bc" * 500, "'s'T I'll don't   x", "The the, the. the\nthe", "a\n \nb", " ", "x  y", "don''s ''s", "tail "]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_digests_and_decoding_equal_the_library(spark):
    docs = spark.createDataFrame([(k if k else None, t, 1) for k, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_tokens int")
    t, want = library(), {}
    for k, x in enumerate(TEXTS * 2):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[k or None] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    for share in (bpe.MIN_SHARE, 0.5):
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, min_share=share).collect()} == want
    back = bpe.decode(bpe.encode(docs))
    assert sorted(r.text for r in back.collect()) == sorted(x or "" for x in TEXTS * 2)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_automaton_is_minimal_and_exact(tmp_path):
    words = sorted({a + b + c for a in ("b", "br", "k", "") for b in ("at", "it") for c in ("s", "ted", "")})
    path = tmp_path / "x"
    path.write_bytes(bpe.compile_lexicon([(w.encode(), (k, k + 1)) for k, w in enumerate(words)]))
    lex = bpe.Lexicon(str(path))
    assert [lex.get(w.encode()) for w in words] == [(k, k + 1) for k in range(len(words))]
    assert all(lex.get(w) is None for w in (b"", b"b", b"bats!", b"zz", b"br"))
    assert len(lex.final) < 10  # suffixes are shared
    path.write_bytes(bpe.compile_lexicon([]))
    assert bpe.Lexicon(str(path)).get(b"a") is None


def test_long_words_merge_alike():
    v = bpe.vocabulary(bpe.vocabulary_path())
    rng = np.random.default_rng(1)
    for n in (3, 40, 64, 65, 500):
        w = "".join(rng.choice(list("abcdeinrst"), n))
        assert list(v.merge(w)) == library().encode(w, add_special_tokens=False).ids == list(v._merge_long([v.bytes_ids[b] for b in w.encode()]))


def test_many_words_merge_and_look_up_like_one(tmp_path):
    v = bpe.vocabulary(bpe.vocabulary_path())
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list(" abcdeinrstéß日."), n)) for n in rng.integers(1, 90, 3000)] + ["a" * 64, "the", " the"]
    data, begin, size = bpe.spelled(pa.array(words, pa.large_string()))
    ids, width = v.merge_many(data, begin, size)
    ends = np.cumsum(width)
    assert [tuple(ids[b - n : b].tolist()) for b, n in zip(ends, width, strict=True)] == [v.merge(w) for w in words]
    some = sorted({w.encode() for w in words[::3] if len(w.encode()) <= bpe.LONG})
    path = tmp_path / "x"
    path.write_bytes(bpe.compile_lexicon([(w, v.merge(w.decode())) for w in some]))
    place = {w: k for k, w in enumerate(some)}
    assert bpe.Lexicon(str(path)).many(data, begin, size).tolist() == [place.get(w.encode(), -1) for w in words]


def test_pieces_of_words():
    v = bpe.vocabulary(bpe.vocabulary_path())
    words = ["", " ", "a", " don't", " x1,y", "<|endoftext|>", " a", "a", " é日", "\n\n x", " a."]
    names, pieces, count = bpe.pieces_of(words, v)
    names, at = names.to_pylist(), np.cumsum(count)
    assert [[names[k] for k in pieces[b - n : b]] for b, n in zip(at, count, strict=True)] == [v.pieces(w) for w in words]


def test_cutting_at_spaces_changes_nothing():
    v = bpe.vocabulary(bpe.vocabulary_path())
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(" \n'sxé,1 "), 12)) for _ in range(3000)]
    codes, words, counts = bpe.split_words(pa.array(texts, pa.large_string()), v)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert [p for c in codes[at : at + n] for p in v.pattern.findall(words[c])] == v.pieces(t)
        at += n
