"""WARC archives: a writer with revisit records and a salvage reader.

Writing: payloads of MIN_REVISIT bytes or more that are equal by SHA-256 and length are
stored once, in the record with the smallest page_id; the others become revisit records. Every task writes
its rows as gzip members, one a record, to files of about ROLL bytes in the shared folder, each under a
name that no other attempt uses; what counts is the manifest of the attempts that succeeded.

Reading: records come one after the other. A record must have a version line, a header block,
the length it says, the closing blank lines, and the digests it names. After a failed check the reader
searches for the next gzip member or version line whose record passes, reads on there, and logs the bytes
between as a quarantined gap. A record that is framed rightly but has a wrong digest is passed over as a whole.
A gzip member is inflated bit by bit and searched in the same way, so its good records before and after a
fault are kept, and those before a break of its stream, if the stream went on behind them. Records of
a member begin where it does and end where reading stood. One record is in memory at a time, and what of a
member is searched for the next version line after a fault.

Defined cases: null html is the empty payload; a null url gives a record without target; rows
without page_id are written under an id of their own, revisit others but are no originals
unless no row of the group has a page_id; repeated rows of the smallest page_id are all responses; no pages
give no records. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm.common import new_path, save

MIN_REVISIT = 100
#: Bytes of a file after which the next one begins.
ROLL = 32 << 20
CHUNK = 1 << 20
#: Revisits that are broadcast at most: about 100 MB; more are joined by a shuffle on page_id.
BROADCAST_REVISITS = 500_000
#: Bytes of a gzip member that are inflated at once.
STEP = 1 << 14
LEVEL = 4

RECORD = "archive string, begin long, end long, fault string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


# ------------------------------------------------------------------ writing


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: a response).

    Groups are formed of ids and digests alone; what refers to another page is then met by its own id and digest, so a large group
    of equal pages moves no payload and is no hot key.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    keys = save(rows.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", F.unhex("payload_digest").alias("digest"), F.col("payload_bytes").alias("size")), "keys")
    equal = keys.groupBy("digest", "size").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL").select("digest", "size", "least")
    again = keys.join(save(equal, "equal"), ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("least")))
    again = save(again.select(F.col("page_id").alias("_page"), F.hex("digest").alias("_digest"), "least").distinct(), "revisits")
    if again.count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    found = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.upper("payload_digest") == F.col("_digest")), "left")
    return found.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.col("least").alias("refers_to"))


def record(page_id, url, html: str, size: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record of an HTTP response or a revisit of it."""
    payload = html.encode() if refers_to is None else b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, roll: int = ROLL, compress: bool = True) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); the manifest: path, n_records, n_bytes."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, k, out, n, size, done = TaskContext.get().partitionId(), 0, None, 0, 0, []

        def close():
            nonlocal out, n, size
            if out is not None:
                out.close()
                done.append((path, n, size))
                out, n, size = None, 0, 0

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{part:05d}-{k:04d}-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    path, out, k = f"{folder.rstrip('/')}/{name}", fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None), k + 1
                data = record(*(x.as_py() for x in row))
                if compress:
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*done, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "n_records", "n_bytes"])

    return save(marked(pages).mapInArrow(work, "path string, n_records long, n_bytes long"), "manifest")


# ------------------------------------------------------------------ reading


class Fault(Exception):
    """A failed check; end: where the record ends, if its frame is right."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


class Source:
    """Bytes of an archive by place, read in chunks."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.held = f, size, 0, b""
        self.marks: dict[bytes, tuple[int, int]] = {}

    def get(self, lo: int, n: int) -> bytes:
        """Up to n bytes from lo on."""
        if lo < self.at or lo + n > self.at + len(self.held):
            self.f.seek(lo)
            self.at, self.held = lo, self.f.read(max(n, CHUNK))
        return self.held[lo - self.at : lo - self.at + n]

    def find(self, mark: bytes, lo: int) -> int:
        """The first place of mark at or after lo, or -1; what the last search for it passed over is not read again."""
        begun, place = self.marks.get(mark, (0, 0))
        if mark not in self.marks or lo < begun or 0 <= place < lo:
            begun, place = lo, self._search(mark, lo)
            self.marks[mark] = begun, place
        return place

    def _search(self, mark: bytes, lo: int) -> int:
        while lo < self.size:
            if lo < self.at or lo + len(mark) > self.at + len(self.held):
                self.get(lo, CHUNK)
            if (k := self.held.find(mark, lo - self.at)) >= 0:
                return self.at + k
            lo = self.at + len(self.held) - len(mark) + 1
            if lo + len(mark) > self.size:
                return -1
        return -1


def header_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Fault("no version line")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Fault("header line without a colon")
        out[name.strip().lower()] = value.strip()
    return out


def framed(s: Source, lo: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the plain record at lo."""
    if s.get(lo, 5) != b"WARC/" or (end := s.find(b"\r\n\r\n", lo)) < 0:
        raise Fault("no version line")
    head = header_of(s.get(lo, end - lo))
    if not head.get("content-length", "").isdigit():
        raise Fault("no length")
    n = int(head["content-length"])
    if end + 8 + n > s.size:
        raise Fault("cut off")
    block = s.get(end + 4, n + 4)
    if block[n:] != b"\r\n\r\n":
        raise Fault("no closing lines")
    return head, block[:n], end + 8 + n


def checked(head: dict[str, str], block: bytes, end: int | None) -> dict:
    """The record's row, after its digests."""
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    kind = head.get("warc-type", "")
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        how, _, said = head.get(name, "").partition(":")
        if how == "sha256" and not (kind == "revisit" and name == "warc-payload-digest") and hashlib.sha256(data).hexdigest() != said:
            raise Fault(f"wrong {name}", end)
    number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() else None
    own = kind != "revisit"
    return {
        "page_id": number(head.get("warc-record-id", "")),
        "record_type": kind,
        "url": head.get("warc-target-uri"),
        "payload_bytes": len(payload) if own else int(head.get("warc-payload-length", "0")),
        "payload_digest": hashlib.sha256(payload).hexdigest() if own else head.get("warc-payload-digest", "").removeprefix("sha256:"),
        "refers_to": number(head.get("warc-refers-to", "")),
        "payload": payload if own else None,
    }


class Member(Source):
    """The inflated bytes of the gzip member at a place of s, by place, read forwards; fault: why they end too early."""

    def __init__(self, s: Source, start: int):
        self.s, self.end, self.z, self.at, self.held, self.fault, self.size = s, start, zlib.decompressobj(31), 0, bytearray(), None, math.inf
        self.marks = {}

    def more(self) -> None:
        data = self.s.get(self.end, STEP)
        before, out = self.z.copy(), b""
        try:
            out = self.z.decompress(data)
            self.end += len(data) - len(self.z.unused_data)
        except zlib.error as e:  # what comes before the break
            self.fault = f"gzip: {e}"
            try:
                for k in range(len(data)):
                    out += before.decompress(data[k : k + 1])
                    self.end += 1
            except zlib.error:
                pass
        self.held += out
        if not data and not self.z.eof:
            self.fault = "cut off"
        if self.fault or self.z.eof:
            self.size = self.at + len(self.held)

    def get(self, lo: int, n: int) -> bytes:
        while self.at + len(self.held) < lo + n and self.size == math.inf:
            self.more()
        return bytes(self.held[lo - self.at : lo - self.at + n])

    def forget(self, lo: int) -> None:
        """Bytes before lo are not asked for again."""
        del self.held[: lo - self.at]
        self.at = lo


class Bytes:
    """A file of bytes in memory, for records of one gzip member."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        return self.data[self.at : self.at + n]


def inside(m: Member) -> Iterator[dict | str]:
    """Rows of the records of a member that pass, and the reasons of the gaps between them."""
    k, gap = 0, None
    while m.get(k, 1):
        try:
            head, block, end = framed(m, k)
            row = checked(head, block, end)
            if not m.get(end, 1) and m.fault:
                raise Fault(m.fault)
        except Fault as e:
            gap = gap or e.reason
            k = e.end if e.end is not None else m.find(b"WARC/1.", k + 1)
            if k < 0:
                break
        else:
            if gap is not None:
                yield gap
                gap = None
            yield row
            k = end
        m.forget(k)
    while m.size == math.inf:
        m.forget(m.at + len(m.held))
        m.more()
    if gap is not None or m.fault:
        yield m.fault or gap


def salvage(s: Source) -> Iterator[dict]:
    """Rows of all records that pass, and of the gaps between them (fault set)."""
    at, gap = 0, None
    while at < s.size:
        if s.get(at, 3) == b"\x1f\x8b\x08":
            m = Member(s, at)
            for r in inside(m):
                if isinstance(r, str):
                    gap = gap or (at, r)
                    continue
                if gap is not None:
                    yield {"begin": gap[0], "end": at if gap[0] < at else m.end, "fault": gap[1]}
                    gap = None
                yield r | {"begin": at, "end": m.end, "fault": None}
            if m.fault is None:
                at = m.end
                continue
        else:
            try:
                head, block, end = framed(s, at)
                row = checked(head, block, end)
            except Fault as e:
                gap = gap or (at, e.reason)
                if e.end is not None:
                    at = e.end
                    continue
            else:
                if gap is not None:
                    yield {"begin": gap[0], "end": at, "fault": gap[1]}
                    gap = None
                yield row | {"begin": at, "end": end, "fault": None}
                at = end
                continue
        found = [x for mark in (b"\x1f\x8b\x08", b"WARC/1.") if (x := s.find(mark, at + 1)) >= 0]
        at = min(found, default=s.size)
    if gap is not None:
        yield {"begin": gap[0], "end": s.size, "fault": gap[1]}


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD rows of the archives named by manifest (path): records, and quarantined gaps with fault set."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, RECORD.split(", "), strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(at) as f:
                    for r in salvage(Source(f, f.size())):
                        if not payloads:
                            r["payload"] = None
                        rows.append(r | {"archive": path})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= 5000 or held >= 8 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(work, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, read back from archives."""
    back = read(write(pages), payloads=False)
    sound = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("quarantined: "), "archive", F.lit(" "), "fault")).cast("long")).otherwise(F.col("page_id"))
    return back.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  g AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN least <> page_id THEN least END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)"""
