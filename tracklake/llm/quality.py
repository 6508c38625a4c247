"""Quality rules: text statistics, and a calibrated logistic regression over hashed n-grams.

Features of a text are how often words, word pairs and character n-grams of 1 to 3 bytes within
words occur per word, hashed to 2^BITS slots. The model is trained on labelled quality rows: at most
TRAIN_ROWS of them, those with the least hash of doc_id, which is the documented bound of what the
driver holds. A fifth of these is held out for Platt scaling, which turns the margin into a
probability of good quality. Whole tables are scored in Arrow batches against fixed thresholds: the two base
rules, and LEAST_PROBABILITY. Tasks make the feature rows, the driver only fits
them; weights (2^BITS floats) are all that is sent back to tasks.

Defined cases: a null text has no words and fails the base rules; labels without quality or doc_id,
or without a document, are not used; repeated rows are judged each; without labels of both classes the
method keeps what the base rules keep; no documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.bpe import steps
from tracklake.llm.common import hashes_of, mix, save, tidy, words_of

BITS = 17
TRAIN_ROWS, TRAIN_VALUES = 3000, 32 << 20
LEAST_PROBABILITY = 0.7
#: Bytes of texts that a task works on at once; its arrays take some 60 times that.
STEP = 1_000_000
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SCALE, STEPS, RATE, SHRINK = 10.0, 150, 0.3, 1e-5


def slot(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(kind + 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def letters(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all character n-grams of the words, a space at both ends, and the words' places."""
    n = len(names)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = names.cast(pa.large_binary())
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + n + 1]
    data = np.frombuffer(names.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    text = np.full(int(size.sum()) + 2 * n, 32, np.uint64)
    text[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), size)] = data
    owner = np.repeat(np.arange(n), size + 2)
    slots, owners, h = [], [], text
    for k in (1, 2, 3):
        if k > 1:
            h = h[:-1] * np.uint64(257) + text[k - 1 :]
        whole = owner[: len(h)] == owner[k - 1 :]
        slots.append(slot(h[whole], 10 + k))
        owners.append(owner[k - 1 :][whole])
    return np.concatenate(slots), np.concatenate(owners)


def pairs(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = at[1:] == at[:-1]
    with np.errstate(over="ignore"):
        return slot((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[whole], 2), at[1:][whole]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, slots and values of the feature matrix of some texts."""
    at, words = words_of(texts, lower=False)
    h, codes, names = hashes_of(words)
    p, p_at = pairs(h, at)
    c, owner = letters(names)
    begin = np.searchsorted(owner[(order := np.argsort(owner, kind="stable"))], np.arange(len(names) + 1))
    c = c[order]
    width = np.diff(begin)[codes]
    ends = np.cumsum(width)
    each = c[np.repeat(begin[codes] - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)]
    rows = np.concatenate([at, p_at, np.repeat(at, width)])
    key, count = np.unique(rows << BITS | np.concatenate([slot(h, 1), p, each]), return_counts=True)
    n = np.maximum(np.bincount(at, minlength=len(texts)), 1)
    return key >> BITS, key & ((1 << BITS) - 1), SCALE * count / n[key >> BITS]


class Model:
    """Weights of the slots, bias, and the two numbers of the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def margins(self, h: np.ndarray, at: np.ndarray, codes: np.ndarray, names: pa.Array, n: int) -> np.ndarray:
        c, owner = letters(names)
        of_word = np.bincount(owner, self.weights[c], len(names)) if len(c) else np.zeros(len(names))
        p, p_at = pairs(h, at)
        total = np.bincount(at, self.weights[slot(h, 1)] + of_word[codes], n) + np.bincount(p_at, self.weights[p], n)
        return self.bias + SCALE * total / np.maximum(np.bincount(at, minlength=n), 1)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * margin + self.b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def chunked(texts: pa.Array, most: int = 64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The feature matrix in parts of a few rows: row numbers, slots, values, in four bytes each."""
    out = []
    for lo in range(0, len(texts), most):
        r, s, v = features(texts.slice(lo, most).take(pa.array(np.arange(min(most, len(texts) - lo)))))
        out.append(((r + lo).astype(np.int32), s.astype(np.int32), v.astype(np.float32)))
    return out


def fit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], good: np.ndarray) -> Model | None:
    """Logistic regression by Adam on four fifths of the rows, Platt scaling on the others.

    parts: rows, slots and values of the feature matrix, part after part; only one part is widened at a time.
    """
    n_rows = len(good)
    if n_rows < 10 or len(set(good.tolist())) < 2:
        return None
    held = np.arange(n_rows) % 5 == 4
    if len(set(good[held].tolist())) < 2 or len(set(good[~held].tolist())) < 2:
        held[:] = False
    n = (~held).sum()
    share = np.where(good == 1, 0.5 / good[~held].mean(), 0.5 / (1 - good[~held].mean())) * ~held / n  # classes weigh the same
    w, bias = np.zeros(1 << BITS), 0.0
    m, q, mb, qb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def margins() -> np.ndarray:
        out = np.full(n_rows, bias)
        for r, s, v in parts:
            if len(r):
                out[r[0] : r[-1] + 1] += np.bincount(r - r[0], w[s] * v)
        return out

    for k in range(1, STEPS + 1):
        wrong = share * (sigmoid(margins()) - good)
        g, gb = SHRINK * w, wrong.sum()
        for r, s, v in parts:
            g += np.bincount(s, wrong[r] * v, 1 << BITS)
        m, q, mb, qb = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * qb + 0.01 * gb * gb
        up, down = 1 - 0.9**k, 1 - 0.99**k
        w -= RATE * (m / up) / (np.sqrt(q / down) + 1e-6)
        bias -= RATE * (mb / up) / (np.sqrt(qb / down) + 1e-6)
    margin = margins()
    a, b = platt(margin[held], good[held]) if held.any() else (1.0, 0.0)
    return Model(w.astype(np.float32), float(bias), a, b)


def platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a and b of sigmoid(a * margin + b), by Newton steps on smoothed targets."""
    up, down = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, t = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = sigmoid(x @ t)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        t = t - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(max(t[0], 1e-3)), float(t[1])


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model | None:
    """The model of at most `most` labelled rows and TRAIN_VALUES feature values; of repeated rows of an id one is taken."""
    some = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded by `most`, so small enough to broadcast
    found = documents.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(some.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))), F.col("doc_id") == F.col("_id"))
    made = save(found.select("doc_id", "quality", "text").mapInArrow(tidy(_featured), "doc_id long, quality int, slots array<int>, counts array<float>"), "features")
    made = made.dropDuplicates(["doc_id"])
    sizes = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over `most` rows at most
    fits = save(made.select("doc_id", F.sum(F.size("slots")).over(sizes).alias("values")).where(F.col("values") <= TRAIN_VALUES).select("doc_id"), "sample")
    got = made.join(F.broadcast(fits), "doc_id", "left_semi").toArrow().sort_by("doc_id")
    parts = []
    for lo in range(0, len(got), 256):
        part = got.slice(lo, 256).combine_chunks()
        slots, values = part["slots"].combine_chunks(), part["counts"].combine_chunks()
        rows = np.repeat(np.arange(lo, lo + len(part), dtype=np.int32), np.diff(np.asarray(slots.offsets)))
        parts.append((rows, np.asarray(slots.flatten()), np.asarray(values.flatten())))
    return fit(parts, got["quality"].to_numpy())


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feature rows of labelled texts that the base rules keep; they decide the others."""
    for batch in batches:
        for lo, texts in steps(batch, most=STEP):
            left = np.flatnonzero(~judged(texts, None, 0.0)["base_failed"])
            for r, s, v in chunked(texts.take(pa.array(left))):
                if not len(r):
                    continue
                here, count = np.unique(r, return_counts=True)
                bounds = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                at = pa.array(lo + left[here])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(at), batch.column("quality").cast(pa.int32()).take(at), pa.ListArray.from_arrays(bounds, pa.array(s)), pa.ListArray.from_arrays(bounds, pa.array(v))], names=["doc_id", "quality", "slots", "counts"])


def statistics(texts: pa.Array, model: Model | None) -> dict[str, np.ndarray]:
    """Counts and the probability of good quality of each text."""
    n = len(texts)
    at, words = words_of(texts, lower=False)
    h, codes, names = hashes_of(words)
    n_words = np.bincount(at, minlength=n)
    count = lambda chars: sum(np.asarray(pc.count_substring(texts, c), np.int64) for c in chars)
    lines = pc.split_pattern(texts, "\n")
    sizes = np.diff(np.asarray(lines.offsets))
    line = lines.flatten()
    line_at = np.repeat(np.arange(n), sizes)
    full = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)) if len(line) else np.zeros(0, bool)
    line_codes = np.asarray(line.dictionary_encode().indices, np.int64)
    keys = np.unique(line_at[full] * (len(line) + 1) + line_codes[full])
    dup = np.bincount(line_at[full], minlength=n) - np.bincount(keys // (len(line) + 1), minlength=n)
    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        begin = np.flatnonzero(at[2:] == at[:-2])
        with np.errstate(over="ignore"):
            key = mix(mix(mix(h[begin] + at[begin].astype(np.uint64)) + h[begin + 1]) + h[begin + 2])
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = begin[times[back] > 1]
        for k in range(3):
            repeated[twice + k] = True
    return {
        "n_words": n_words,
        "word_chars": np.asarray(pc.utf8_length(texts), np.int64) - count(WHITE),
        "n_symbols": count(SYMBOLS),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(at[repeated], minlength=n),
        "probability": model.probability(model.margins(h, at, codes, names, n)) if model else np.ones(n),
    }


def judged(texts: pa.Array, model: Model | None, least: float) -> dict[str, np.ndarray]:
    s = statistics(texts, model)
    s["base_failed"] = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])
    s["kept"] = ~s["base_failed"] & (s["probability"] >= least)
    return s


def judge(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, least: float = LEAST_PROBABILITY) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, probability for each row of documents."""
    model = train(documents, labels, most)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in steps(batch, most=STEP):
                s = judged(texts, model, least)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)).cast(pa.int64()), *(pa.array(s[c].astype(np.int64)) for c in counts), pa.array(s["base_failed"]), pa.array(s["kept"]), pa.array(s["probability"])], names=["doc_id", *counts, "base_failed", "kept", "probability"])

    return documents.select("doc_id", "text").mapInArrow(tidy(work), "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, probability double")


def keep(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The rows of documents that pass, with all their columns."""
    model = train(documents, labels, most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in steps(batch, most=STEP):
                yield batch.slice(lo, len(texts)).filter(pa.array(judged(texts, model, least)["kept"]))

    return documents.mapInArrow(tidy(work), documents.schema)
