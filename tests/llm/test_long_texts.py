"""Each operator on texts of more than 20,000 words, beside a short one."""

import hashlib
import math
import random
import re

import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import bpe, exact_dedup, language_model, minhash, quality, warc  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(8)
LONG = " ".join(f"{RNG.choice(['Über', 'the', 'word'])}{RNG.randrange(9000)}" + ("\n" if k % 40 == 0 else "") for k in range(25_000))
ROWS = [(1, LONG), (2, LONG.replace("\n", " \t ")), (3, LONG + " more words at its end"), (4, "short text")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_near_and_exact_copies(docs):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sizes = {d: len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for d, t in ROWS for w in [WORD.findall(lower(t))]}
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (n, 4 if d == 4 else 1) for d, n in sizes.items()}
    assert sorted(r.doc_id for r in minhash.keep(docs).collect()) == [1, 4]
    digest = {d: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest() for d, t in ROWS}
    assert {r.doc_id: (r.keep_id, r.text_sha256) for r in exact_dedup.dedup(docs).collect()} == {d: (1 if d == 2 else d, digest[d]) for d in digest}


def test_language_model(docs):
    import zlib

    got = {r.doc_id: r for r in language_model.score(docs).collect()}
    words = {d: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)), None] for d, t in ROWS}
    counts: dict = {}
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 10:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for d, w in words.items():
        base = sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (got[d].n_tokens, got[d].train_tokens) == (len(w), n) and abs(got[d].base_score - base) < 1e-6 * abs(base) and math.isfinite(got[d].score)


def test_tokens(docs):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    tok.no_truncation()
    tok.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.digests(docs).collect()}
    for d, t in ROWS:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.base_failed) for r in quality.judge(docs, labels).collect()}
    for d, t in ROWS:
        w = WORD.findall(t)
        assert got[d][:3] == (len(w), sum(map(len, w)), 0) and (len(w) >= 50 or got[d][3])


def test_warc_records(spark):
    pages = spark.createDataFrame([(d, f"http://h/{d}", t) for d, t in [*ROWS, (9, LONG)]], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()}
    for d, t in ROWS:
        assert got[d] == (len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), "response", None)
    assert got[9][2:] == ("revisit", 1)
