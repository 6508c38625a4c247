"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The corpus is pre-tokenised once and its words counted by Spark. Words with at least MIN_SHARE of
all word occurrences (so at most 1 / MIN_SHARE words, whatever the input) are merged exactly
and compiled on the driver into a minimal acyclic automaton: states with equal right languages are shared,
and each arc holds the number of words that sort before those below it, so the sum along a path is the
word's ordinal and points at its ids. The automaton is three integer arrays in one file, which Spark ships to every
executor and every task maps into memory. All other words are merged exactly by rank, those of a step
together; a step looks each distinct word up once.

The added special token of the vocabulary file is cut out first, as the tokenizers library does.
Defined cases: a null text counts as empty and has no ids; repeated rows come back as often; rows
without doc_id are encoded too; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import drop, own_copy, save, shared_dir

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIN_SHARE = 2e-5
#: The rank of a pair that never merges, in merge() and in arrays.
NEVER = (1 << 30, -1)
NO_RANK = np.iinfo(np.int32).max
#: Words of more bytes are merged with a heap; the lexicon has none of them.
LONG = 64
#: Bytes of text that one step holds at once; encoding gains from larger ones, as words come back within a step.
STEP, ENCODE_STEP = 4_000_000, 8_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that the vocabulary file writes for each byte: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (k, self.ids[raw(a) + raw(b)]) for k, (a, b) in enumerate(pairs)}
        self.bytes_ids = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.of_id = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.keys = np.array(sorted(a << 32 | b for a, b in self.ranks), np.int64)
        self.rank_of = np.array([self.ranks[k >> 32, k & 0xFFFFFFFF][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([m for _, m in self.ranks.values()], np.int32)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)

    def merge(self, word: str) -> tuple[int, ...]:
        """Exact merging: the adjacent pair of lowest rank first, the leftmost of equals."""
        ids = list(map(self.bytes_ids.__getitem__, word.encode()))
        if len(ids) > LONG:
            return self._merge_long(ids)
        rank = self.ranks.get
        found = list(map(rank, zip(ids, ids[1:]), repeat(NEVER)))
        while found and (best := min(found)) is not NEVER:
            k = found.index(best)
            ids[k : k + 2] = (best[1],)
            del found[k]
            if k:
                found[k - 1] = rank((ids[k - 1], ids[k]), NEVER)
            if k < len(found):
                found[k] = rank((ids[k], ids[k + 1]), NEVER)
        return tuple(ids)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NO_RANK for pairs that never merge."""
        key = a.astype(np.int64) << 32 | b
        if not len(self.keys):
            return np.full(key.shape, NO_RANK, np.int32)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.rank_of[k], NO_RANK)

    def merge_many(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words, given by their bytes: all ids, and the number of ids of each word.

        Words of one length are the rows of a matrix. A round merges in every row the leftmost pair of lowest
        rank, so rows keep one length, and rows without a pair that merges leave.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        bytes_ids = np.array(self.bytes_ids, np.int32)
        for n in np.unique(size[size <= LONG]).tolist():
            who = np.flatnonzero(size == n)
            tok = bytes_ids[data[begin[who][:, None] + np.arange(n)]]
            rank = self._ranks(tok[:, :-1], tok[:, 1:])
            while rank.shape[1] and len(who):
                row = np.arange(len(who))
                best = rank.argmin(axis=1)
                low = rank[row, best]
                live = low < NO_RANK
                if not live.all():
                    done.append((who[~live], tok[~live]))
                    who, tok, rank, best, low, row = who[live], tok[live], rank[live], best[live], low[live], np.arange(live.sum())
                at = best[:, None]
                cols = np.arange(tok.shape[1] - 1)
                tok = np.take_along_axis(tok, cols + (cols > at), 1)
                tok[row, best] = self.made[low]
                rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= at), 1)
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < rank.shape[1])
                rank[left, best[left] - 1] = self._ranks(tok[left, best[left] - 1], tok[left, best[left]])
                rank[right, best[right]] = self._ranks(tok[right, best[right]], tok[right, best[right] + 1])
            done.append((who, tok))
        for k in np.flatnonzero(size > LONG):
            ids = self._merge_long(bytes_ids[data[begin[k] : begin[k] + size[k]]].tolist())
            done.append((np.array([k]), np.array([ids], np.int32)))
        width = np.zeros(len(size), np.int64)
        for who, tok in done:
            width[who] = tok.shape[1]
        start = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int32)
        for who, tok in done:
            out[start[who][:, None] + np.arange(tok.shape[1])] = tok
        return out, width

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list, for very long words."""
        import heapq

        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(n - 1) if (r := self.ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (r := self.ranks.get((ids[x], ids[after[x]]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[after[x]], r[1]))
        return tuple(x for x in ids if x >= 0)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(words: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """A minimal acyclic automaton of sorted distinct words with their ids, as one block of integers."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []

    def settle(node) -> int:
        final, arcs = node[0], tuple(sorted(node[1].items()))
        key = (final, arcs)
        if key not in register:
            register[key] = len(states)
            states.append((final, arcs, final + sum(states[t][2] for _, t in arcs)))
        return register[key]

    path: list[list] = [[False, {}]]
    last = b""
    for word, _ in words:
        if word <= last and path[0] != [False, {}]:
            raise ValueError("words must be sorted and distinct")
        common = next((k for k in range(min(len(word), len(last))) if word[k] != last[k]), min(len(word), len(last)))
        while len(path) - 1 > common:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = settle(node)
        for _ in word[common:]:
            path.append([False, {}])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][last[len(path) - 1]] = settle(node)
    root = settle(path[0])
    first, label, target, skip = [0], [], [], []
    for final, arcs, _ in states:
        passed = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            skip.append(passed)
            passed += states[t][2]
        first.append(len(label))
    finals = [int(s[0]) for s in states]
    ids = [x for _, w in words for x in w]
    start = np.concatenate([[0], np.cumsum([len(w) for _, w in words])]) if words else np.zeros(1)
    parts = [np.asarray(x, np.int32) for x in (first, finals, label, target, skip, start, ids)]
    return struct.pack("<8i", root, *map(len, parts)) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The compiled automaton, mapped from its file; a state's arcs are sorted by byte."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("i")
        self.root, at, parts = data[0], 8, []
        for n in data[1:8]:
            parts.append(data[at : at + n])
            at += n
        self.first, self.final, self.label, self.target, self.skip, self.start, self.ids = parts

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, ordinal = self.root, 0
        first, label, target, skip = self.first, self.label, self.target, self.skip
        for b in word:
            hi = first[state + 1]
            k = bisect_left(label, b, first[state], hi)
            if k == hi or label[k] != b:
                return None
            ordinal += skip[k]
            state = target[k]
        if not self.final[state]:
            return None
        return tuple(self.ids[self.start[ordinal] : self.start[ordinal + 1]])


    def many(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ordinal of each word, given by its bytes, or -1: all words go through the automaton together."""
        label, target, skip, first, final = (np.asarray(x) for x in (self.label, self.target, self.skip, self.first, self.final))
        keys = np.repeat(np.arange(len(first) - 1, dtype=np.int64) << 8, np.diff(first)) | label
        out = np.full(len(size), -1, np.int64)
        who = np.flatnonzero(size <= LONG)
        state, ordinal, k = np.full(len(who), self.root, np.int64), np.zeros(len(who), np.int64), 0
        while len(who) and len(keys):
            ended = size[who] == k
            accepted = ended & (final[state] > 0)
            out[who[accepted]] = ordinal[accepted]
            who, state, ordinal = who[~ended], state[~ended], ordinal[~ended]
            arc = state << 8 | data[begin[who] + k]
            at = np.minimum(np.searchsorted(keys, arc), len(keys) - 1)
            found = keys[at] == arc
            who, at = who[found], at[found]
            state, ordinal, k = target[at].astype(np.int64), ordinal[found] + skip[at], k + 1
        return out


@lru_cache(maxsize=2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a batch's texts of about `most` bytes each, null as empty, so that memory does not follow the batch."""
    whole = batch.column(column)
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole), 0), np.int64))
    lo = 0
    while lo < len(whole):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + most, "right")))
        yield lo, pc.fill_null(own_copy(whole.slice(lo, hi - lo)).cast(pa.large_string()), "")
        pa.default_memory_pool().release_unused()
        lo = hi


#: A space beside other white space, or at an end: there a cut at the space would part a token.
UNSAFE = r"^ | $| [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def split_words(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words in order, the distinct words, and the number of words of each text.

    Where a text's spaces stand alone between other characters, a token begins at each of them: the
    text is cut there by Arrow, and only distinct words meet the pattern. Other texts, and those
    that hold special tokens, are cut by the pattern as a whole.
    """
    slow = np.asarray(pc.match_substring_regex(texts, UNSAFE)).copy()
    for token in v.special:
        slow |= np.asarray(pc.match_substring(texts, token))
    lists = pc.split_pattern(pc.if_else(pa.array(slow), pa.scalar("", texts.type), texts), " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets -= offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    words = [" " + w for w in names]
    # a text's first word has no space before it
    first = offsets[:-1]
    heads, head_codes = np.unique(codes[first], return_inverse=True) if len(first) else (first, first)
    codes[first] = len(words) + head_codes
    words += [names[k] for k in heads]
    counts = np.diff(offsets)
    if slow.any():
        known: dict[str, int] = {}
        begin, parts, done = offsets.copy(), [], 0
        for k in np.flatnonzero(slow):
            parts.append(codes[done : begin[k]])
            own = v.pieces(texts[int(k)].as_py())
            for w in own:
                known.setdefault(w, len(words) + len(known))
            parts.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
            counts[k], done = len(own), begin[k + 1]
        codes = np.concatenate([*parts, codes[done:]])
        words += list(known)
    return codes, words, counts


#: Words of letters alone, after a space or none, which the pattern leaves whole.
WHOLE = r"^ ?\pL+$"


def pieces_of(words: list[str], v: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces that the pattern makes of words, the pieces of all words in order, and their number for each word."""
    names = pa.array(words, pa.large_string())
    whole = np.asarray(pc.match_substring_regex(names, WHOLE), bool) if words else np.zeros(0, bool)
    rest = np.flatnonzero(~whole)
    parts = [[w] if (w := words[k]) in v.special else v.pattern.findall(w) for k in rest]
    count = np.ones(len(words), np.int64)
    count[rest] = list(map(len, parts))
    coded = pa.concat_arrays([names.filter(pa.array(whole)), pa.array(chain.from_iterable(parts), pa.large_string())]).dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    out = np.empty(len(codes), np.int64)
    inside = np.repeat(whole, count)
    out[inside], out[~inside] = codes[: whole.sum()], codes[whole.sum() :]
    return coded.dictionary, out, count


def spelled(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all names, and where each begins and how many it has."""
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
    data = np.frombuffer(names.buffers()[2], np.uint8) if len(names) and names.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def word_counts(documents: DataFrame, path: str, min_share: float) -> DataFrame:
    """word, n and total: words of up to LONG bytes that make up min_share of all occurrences, or nearly so.

    Lossy counting: a step leaves out words whose count in it is below an eighth of that share of its
    occurrences, so memory stays in proportion to 1 / min_share. A task that holds many words drops the rare ones by the same rule. Counts of
    all tasks are then summed; none is short by more than a quarter of the share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen, total = vocabulary(path), Counter(), 0
        for batch in batches:
            for _, texts in steps(batch, most=ENCODE_STEP):
                codes, words, _ = split_words(texts, v)
                names, pieces, width = pieces_of(words, v)
                n = np.bincount(pieces, np.repeat(np.bincount(codes, minlength=len(words)), width), len(names)).astype(np.int64)
                total += int(n.sum())
                often = np.flatnonzero((n >= min_share / 8 * n.sum()) & (spelled(names)[2] <= LONG))
                for w, k in zip(names.take(pa.array(often)).to_pylist(), n[often].tolist(), strict=True):
                    seen[w] += k
                if len(seen) > 16 / min_share:
                    seen = Counter({w: k for w, k in seen.items() if k >= min_share / 8 * total})
        yield pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.string()), pa.array([*seen.values(), total], pa.int64())], names=["word", "n"])

    return documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, vocabulary_file: str, min_share: float = MIN_SHARE) -> str:
    """Compile the frequent words and ship the file to the executors; returns its name there.

    At most 1.34 / min_share words of up to LONG bytes come to the driver. The file is named by its content, so the
    same lexicon is shipped once.
    """
    spark = documents.sparkSession
    seen = save(word_counts(documents, vocabulary_file, min_share), "words")
    total = seen.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    frequent = [r.word for r in seen.where(F.col("word").isNotNull() & (F.col("n") >= F.lit(0.75 * min_share * total))).select("word").collect()]
    drop(seen)
    v = vocabulary(vocabulary_file)
    words = sorted((w.encode(), v.merge(w)) for w in frequent if w and w not in v.special)
    data = compile_lexicon(words)
    name = f"lexicon-{hashlib.sha256(data).hexdigest()}.bin"
    path = f"{shared_dir(spark)}/{name}"
    fs, at = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(data)
    spark.sparkContext.addFile(path)
    return name


class Encoder:
    """Ids of words: frequent ones by the lexicon, all others by merging."""

    def __init__(self, path: str, name: str):
        self.v, self.lexicon = vocabulary(path), lexicon(SparkFiles.get(name))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one word after the other, and the number of ids of each."""
        names, pieces, count = pieces_of(words, self.v)
        data, begin, size = spelled(names)
        ordinal = self.lexicon.many(data, begin, size)
        for token, k in self.v.special.items():
            ordinal[np.asarray(pc.equal(names, token), bool)] = -2 - k
        unseen = np.flatnonzero(ordinal == -1)
        merged, merged_width = self.v.merge_many(data, begin[unseen], size[unseen])
        starts, ids = np.asarray(self.lexicon.start).astype(np.int64), np.asarray(self.lexicon.ids)
        tokens = np.arange(max(self.v.of_id) + 1, dtype=np.int32)  # a special token's id stands at its own place
        table = np.concatenate([ids, merged, tokens])
        first, width = np.empty(len(names), np.int64), np.ones(len(names), np.int64)
        known = ordinal >= 0
        first[known], width[known] = starts[ordinal[known]], (starts[1:] - starts[:-1])[ordinal[known]]
        first[unseen], width[unseen] = len(ids) + np.cumsum(merged_width) - merged_width, merged_width
        special = ordinal < -1
        first[special] = len(ids) + len(merged) - 2 - ordinal[special]
        ends = np.concatenate([[0], np.cumsum(width[pieces])])
        word_ends = np.concatenate([[0], np.cumsum(count)])
        return gathered(table, first[pieces], width[pieces]), np.diff(ends[word_ends])


def gathered(table: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The runs of a table that begin at `first`, one after the other."""
    ends = np.cumsum(width)
    return table[np.repeat(first - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)]


def encode_texts(texts: pa.Array, e: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one text after the other, and the bounds of the texts."""
    codes, words, counts = split_words(texts, e.v)
    flat, size = e.words(words)
    width = size[codes]
    ends = np.concatenate([[0], np.cumsum(width)])
    return gathered(flat, (np.cumsum(size) - size)[codes], width), ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(v.of_id.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(documents: DataFrame, path: str | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, ids for each row of documents."""
    path = path or vocabulary_path()
    name = build_lexicon(documents, path, min_share)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(path, name)
        for batch in batches:
            for lo, texts in steps(batch, most=ENCODE_STEP):
                ids, bounds = encode_texts(texts, e)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text for each row of encoded (doc_id, ids)."""
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            flat, bounds = np.asarray(ids.values), np.asarray(ids.offsets)
            texts = [decode_ids(flat[a:b], v) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(work, "doc_id long, text string")


def runs(names: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> Iterator[memoryview]:
    """For each text the names of its ids, joined."""
    each = names.take(pa.array(ids))
    at = np.frombuffer(each.buffers()[1], np.int64)[: len(each) + 1] if len(each) else np.zeros(1, np.int64)
    data = memoryview(each.buffers()[2] or b"") if len(each) else memoryview(b"")
    for a, b in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist(), strict=True):
        yield data[a:b]


def digests(documents: DataFrame, path: str | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of documents."""
    path = path or vocabulary_path()
    name = build_lexicon(documents, path, min_share)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(path, name)
        every = range(max(e.v.of_id) + 1)
        decimal = pa.array([f"{k},".encode() for k in every], pa.large_binary())
        spelling = pa.array([e.v.of_id.get(k, b"") for k in every], pa.large_binary())
        for batch in batches:
            for lo, texts in steps(batch, most=ENCODE_STEP):
                ids, bounds = encode_texts(texts, e)
                said = [hashlib.sha256(x[:-1]).hexdigest() for x in runs(decimal, ids, bounds)]
                back = [hashlib.sha256(str(x, "utf-8", "replace").encode()).hexdigest() for x in runs(spelling, ids, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(said), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
