"""Secret scan with a worklist of recursively decoded layers.

A text is layer 0. Every layer is scanned with the three patterns, then searched for encoded stretches: runs of
escapes (of URLs, also %uXXXX; backslash u, U, x, octal and the short ones of JSON; HTML's numbers and names), which decode in place,
so that the whole layer with its escapes undone is the next layer, once more with + as a space in words that hold URL
escapes; and runs of base64 characters, over line ends too. A run may hold an encoding
anywhere (after a path, say), so it is decoded at each of the four alignments: a run that is text as a whole is
a layer, and of others every stretch of LEAST_TEXT or more ASCII characters is, in one byte each or two; and gzip or zlib data
are inflated wherever their first bytes stand among the decoded ones, for every header that zlib takes, while they begin as such data. Layers go on the worklist until none is left; a
layer whose content was seen before for the same stretch is not entered again, which ends cycles.
A layer maps each of its characters to a stretch of the text: escapes to the escape, a decoded run to the
run, stretches of a run to their own characters, inflated data to the compressed ones. Matches of inner layers
are reported with the stretch they map to.

Escapes of escapes of one kind (%252541) are undone in one step. Inflated data have no bound: all their members
are inflated piece by piece and scanned in windows of about WINDOW characters, each a layer, cut where no match or base64
run can go on; a window without such a place grows until one comes, so memory follows the longest
stretch of that kind. Other layers are no longer than their parents.

Defined cases: a null text counts as empty; repeated rows are scanned each; rows without doc_id
are scanned too; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame

from tracklake.llm.common import texts_of, tidy

#: Kinds in their order: name, pattern, group whose length counts, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KINDS = (("assign", ASSIGN, 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24))
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

ESCAPE = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|(?:&#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});)+"
                    r"|(?:%u[0-9A-Fa-f]{4})+|(?:\\U[0-9A-Fa-f]{8})+|(?:\\u\{[0-9A-Fa-f]{1,6}\})+|(?:\\[0-3][0-7]{2})+|(?:\\[nrt\"'/\\])+|(?:&[A-Za-z][A-Za-z0-9]{1,31};)+")
SINGLE = re.compile(r"%u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\([0-3][0-7]{2})|\\([nrt\"'/\\])|&([A-Za-z][A-Za-z0-9]{1,31};)")
SHORT = {"n": "\n", "r": "\r", "t": "\t"}
#: A word with a URL escape, in which + may stand for a space.
FORM = re.compile(r"[^\x20\x09-\x0D%]*+(?:%(?![0-9A-Fa-f]{2})[^\x20\x09-\x0D%]*+)*+%[0-9A-Fa-f]{2}[^\x20\x09-\x0D]*+")
#: The shortest match, token=abcdef, has 12 characters; they encode to 16.
LEAST_TEXT, LEAST_WORD = 12, 16
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
CORE = re.compile(r"[A-Za-z0-9+/_-]+")
ASCII = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}|(?:\x00[\t\n\r\x20-\x7e]){12,}")
#: How gzip data (1f 8b 08) and zlib data begin: method 8, a window of up to 2^15, a sum that 31 divides, no dictionary.
HEADS = [bytes((c, f)) for c in range(0x08, 0x79, 0x10) for f in range(256) if (256 * c + f) % 31 == 0 and not f & 0x20]
PACKED = re.compile(b"\x1f\x8b\x08|" + b"|".join(map(re.escape, HEADS)))
URLSAFE = str.maketrans("-_", "+/")
#: Characters of inflated data that are scanned at once, and bytes that are inflated at once.
WINDOW, PIECE = 1 << 20, 1 << 16
#: Ends of what no match, escape or base64 run goes on over.
SAFE = re.compile(r"[G-WYZg-wyz,.]\x20(?=[A-Za-z0-9])|[,<>(){}\[\]|!?*]")
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "assign":
            low = text.encode("utf-8", "replace").lower()
            if not any(k in low for k in KEYWORDS):
                continue
        elif kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def unescape(run: str) -> list[tuple[str, int, int]]:
    """The characters of a run of escapes, with the stretch of the run that each comes from."""
    if run[0] == "%" and run[1] != "u" or run[:2] == "\\x":
        if run[0] == "%":
            found = [(m[1], m.start(), m.end()) for m in PERCENT.finditer(run)]
        else:
            found = [(run[k + 2 : k + 4], k, k + 4) for k in range(0, len(run), 4)]
        data = bytes(int(x, 16) for x, _, _ in found)
        out, k = [], 0
        while k < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append((data[k : k + n].decode(), found[k][1], found[k + n - 1][2]))
                    k += n
                    break
                except (UnicodeDecodeError, IndexError):
                    continue
            else:
                out.append((chr(data[k]), found[k][1], found[k][2]))
                k += 1
        return out
    out = []
    if run[0] == "&" and run[1] != "#" or run[:2] in ("%u", "\\U") or run[0] == "\\" and run[1] not in "ux" or run[:3] == "\\u{":
        for m in SINGLE.finditer(run):
            code = next((int(x, 16) for x in m.group(1, 2, 3) if x), int(m[4], 8) if m[4] else None)
            if code is None:
                c = SHORT.get(m[5], m[5]) if m[5] else html5.get(m[6], m[0])
            else:
                c = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
            out.append((c, m.start(), m.end()))
        return out
    if run[0] == "\\":
        units = [int(run[k + 2 : k + 6], 16) for k in range(0, len(run), 6)]
        k = 0
        while k < len(units):
            n, c = 1, units[k]
            if 0xD800 <= c < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000:
                n, c = 2, 0x10000 + ((c - 0xD800) << 10) + units[k + 1] - 0xDC00
            out.append(("�" if 0xD800 <= c < 0xE000 else chr(c), k * 6, (k + n) * 6))
            k += n
        return out
    for m in re.finditer(r"&#(?:x([0-9A-Fa-f]+)|([0-9]+));", run):
        c = int(m[1], 16) if m[1] else int(m[2])
        out.append((chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else "�", m.start(), m.end()))
    return out


def readable(data: bytes) -> str | None:
    """The data as text, if it is UTF-8 almost without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(c < " " and c not in "\t\n\r" or c == "\x7f" for c in text)
    return text if text and 20 * odd <= len(text) else None


def decoded(core: str, at: int = 0) -> bytes:
    """The bytes of base64 characters from the one at `at` on; a last character that gives no byte is left out."""
    n = len(core) - at
    n -= n % 4 == 1
    return base64.b64decode(core[at : at + n] + "=" * (-n % 4))


def packed(data: bytes) -> bool:
    return PACKED.match(data) is not None


def begins(data: bytes) -> bool:
    """Whether data that look like compressed ones can be inflated at all."""
    try:
        z = zlib.decompressobj(47)
        return bool(z.decompress(data[:64], 64)) or not z.eof and len(data) > 64 and bool(z.decompress(data[64:1024], 64)) or z.eof
    except zlib.error:
        return False


def members(source: Iterator[bytes], used: list[int] | None = None) -> Iterator[bytes]:
    """The content of the gzip or zlib members of a stream, in pieces, up to a fault or other data; used[0]: bytes of it that they took."""
    z, data, read = None, b"", 0
    for more in source:
        data, read = data + more, read + len(more)
        while True:
            if z is None:
                data = data.lstrip(b"\0")
                if len(data) < 3:
                    break
                if not packed(data):
                    return
                z = zlib.decompressobj(47)
            try:
                out = z.decompress(data, PIECE)
            except zlib.error:
                return
            if used is not None:
                used[0] = read - len(z.unused_data if z.eof else z.unconsumed_tail)
            if out:
                yield out
            if z.eof:
                z, data = None, z.unused_data
                continue
            data = z.unconsumed_tail
            if not data and len(out) < PIECE:
                break


def inflated(core: str, at: int, byte: int, used: list[int]) -> Iterator[bytes]:
    """The content of the data that begin at a byte of the base64 characters from one on, through all compressed layers.

    used[0]: the bytes of the run that the outermost layer took.
    """

    def stream_of() -> Iterator[bytes]:
        first, skip = at + byte // 3 * 4, byte % 3
        for k in range(first, len(core), PIECE):
            yield decoded(core[k : k + PIECE])[skip if k == first else 0 :]

    def level(n: int) -> Iterator[bytes]:
        stream = stream_of()
        for k in range(n):
            stream = members(stream, used if k == 0 else None)
        return stream

    n, seen = 1, set()
    while True:
        head = b""
        for piece in level(n):
            head += piece
            if len(head) >= 3:
                break
        if not packed(head) or next(level(n + 1), None) is None:
            break
        digest = hashlib.sha256()
        for piece in level(n):
            digest.update(piece)
        if digest.digest() in seen:
            return
        seen.add(digest.digest())
        n += 1
    yield from level(n)


def windows(stream: Iterator[bytes]) -> Iterator[str]:
    """The stream as text in windows; what is not UTF-8 becomes a mark that no match holds."""
    decoder, parts, size, most = codecs.getincrementaldecoder("utf-8")("replace"), [], 0, WINDOW
    for piece in stream:
        parts.append(decoder.decode(piece))
        size += len(parts[-1])
        if size < most:
            continue
        held, cut = "".join(parts), 0
        for back in (1 << 10, 1 << 14, size):
            low = max(0, size - back)
            cut = max((m.end() for m in SAFE.finditer(held, low)), default=0)
            if cut:
                yield held[:cut]
                break
        parts, size = [held[cut:]], size - cut
        most = max(WINDOW, 2 * size)
    if size:
        yield "".join(parts)


def base64_layers(layer: Layer, places: Sequence[int], core: str, end: int) -> Iterator[Layer]:
    """The layers in a run of base64 characters, which stand at the places and end, with padding, at end."""
    core = core.translate(URLSAFE)
    runs = [decoded(core, at) for at in range(4)]
    until = 0  # bits of the run that inflated data took; what begins among them is theirs
    for bit, at, byte in sorted((6 * at + 8 * m.start(), at, m.start()) for at in range(4) for m in PACKED.finditer(runs[at])):
        if bit >= until and begins(runs[at][byte : byte + 1024]):
            used = [0]
            for text in windows(inflated(core, at, byte, used)):
                yield Layer(text, layer, [(0, places[bit // 6], end, False)])
            until = bit + 8 * used[0]
    for at, data in enumerate(runs):
        if at == 0 and (text := readable(data)):
            yield Layer(text, layer, [(0, places[0], end, False)])
            continue
        for m in ASCII.finditer(data):
            yield Layer(m[0].decode(), layer, [], (places, at, m.start(), 1))
        if b"\0" in data:
            for m in WIDE.finditer(data):
                yield Layer(m[0].replace(b"\0", b"").decode(), layer, [], (places, at, m.start(), 2))


class Layer:
    """A decoded text, and where its characters come from in its parent: pieces (place, first, end, plain),
    or, for a stretch of a base64 run, the run's places, its alignment, the stretch's first byte and the bytes of a character."""

    def __init__(self, text: str, parent: Layer | None, pieces: list[tuple[int, int, int, bool]], run: tuple[Sequence[int], int, int, int] | None = None):
        self.text, self.parent, self.pieces, self.run = text, parent, pieces, run
        self.places = [p[0] for p in pieces]

    def stretch(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the whole text that the characters [a, b) come from."""
        now = self
        while now.parent is not None:
            if now.run is not None:
                places, at, byte, wide = now.run
                a, b = places[at + (byte + a * wide) * 8 // 6], places[at + ((byte + b * wide) * 8 - 1) // 6] + 1
                now = now.parent
                continue
            place, first, end, plain = now.pieces[bisect_right(now.places, a) - 1]
            place2, first2, end2, plain2 = now.pieces[bisect_right(now.places, b - 1) - 1]
            a = first + a - place if plain else first
            b = first2 + b - place2 if plain2 else end2
            now = now.parent
        return a, b


def undone(layer: Layer, found: list[tuple[int, int, list]]) -> Layer:
    """The layer with stretches (start, end, characters and the stretches of it that they come from) replaced."""
    text, parts, pieces, done, place = layer.text, [], [], 0, 0
    for start, end, characters in found:
        if done < start:
            parts.append(text[done:start])
            pieces.append((place, done, start, True))
            place += start - done
        for c, a, b in characters:
            parts.append(c)
            pieces.append((place, start + a, start + b, False))
            place += len(c)
        done = end
    parts.append(text[done:])
    pieces.append((place, done, len(text), True))
    return Layer("".join(parts), layer, pieces)


def inner_layers(layer: Layer) -> Iterator[Layer]:
    """The next layers of one layer."""
    text = layer.text
    if "%" in text or "\\" in text or "&" in text:
        found = [(m.start(), m.end(), unescape(m[0])) for m in ESCAPE.finditer(text)]
        if found:
            yield undone(layer, found)
        plus = [(k, k + 1, [(" ", 0, 1)]) for m in FORM.finditer(text) if "+" in m[0] for k in range(m.start(), m.end()) if text[k] == "+"] if "%" in text and "+" in text else []
        if plus:
            yield undone(layer, sorted(found + plus))
    for m in BASE64.finditer(text):
        core = m[0].rstrip("=")
        yield from base64_layers(layer, range(m.start(), m.start() + len(core)), core, m.end())
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            parts = list(CORE.finditer(text, m.start(), m.end()))
            if sum(p.end() - p.start() for p in parts) >= LEAST_WORD:
                yield from base64_layers(layer, [k for p in parts for k in range(p.start(), p.end())], "".join(p[0] for p in parts), m.end())


def digest_of(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "replace")).digest()


def all_spans(text: str) -> tuple[list, list]:
    """Base spans of the text, and all spans, those of decoded layers too, by start, then kind."""
    base = base_spans(text)
    found, seen, work = set(base), {(digest_of(text), 0, len(text))}, [inner_layers(Layer(text, None, []))]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        key = (digest_of(inner.text), *inner.stretch(0, len(inner.text)))
        if key not in seen:
            seen.add(key)
            found |= {(kind, *inner.stretch(a, b)) for kind, a, b in base_spans(inner.text)}
            work.append(inner_layers(inner))
    order = {k[0]: n for n, k in enumerate(KINDS)}
    return base, sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def said(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans for each row of documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans, n = ([], [], []), [], [], []
            for text in texts_of(batch):
                base, every = all_spans(text.as_py())
                for k, (kind, *_) in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digest.append(hashlib.sha256(said(base).encode()).hexdigest())
                spans.append(said(every))
                n.append(len(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return documents.select("doc_id", "text").mapInArrow(tidy(work), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by mark."""
    _, spans = all_spans(text)
    out, done = [], 0
    for _, a, b in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def redact(documents: DataFrame, column: str = "text", length: str | None = None) -> DataFrame:
    """documents with secrets replaced in a text column; length: a column to hold the new length."""
    schema = documents.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(column)
            new = [None if t is None else redacted(t) for t in (x.as_py() for x in old)]
            k = batch.schema.get_field_index(column)
            arrays = list(batch.columns)
            arrays[k] = pa.array(new, old.type)
            if length is not None:
                j = batch.schema.get_field_index(length)
                changed = [n is not None and n != x.as_py() for n, x in zip(new, old, strict=True)]
                arrays[j] = pa.array([len(n) if c else w.as_py() for n, c, w in zip(new, changed, arrays[j], strict=True)], arrays[j].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return documents.mapInArrow(tidy(work), schema)
