"""WARC round trips and salvage."""

import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import warc  # noqa: E402

LONG = "<p>é</p>" * 20
ROWS = [(5, "http://a/x", LONG), (2, "http://a/ y", LONG), (9, None, LONG), (3, "http://b", "tiny"), (4, "http://b", "tiny"), (6, "u", None), (None, "n", LONG), (7, "w", "WARC/1.1\r\n\r\n\x1f\x08 trap " * 9), (7, "w", "WARC/1.1\r\n\r\n\x1f\x08 trap " * 9)]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, compress):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, payload string")
    back = warc.read(warc.write(pages, roll=600, compress=compress)).collect()
    assert all(r.fault is None for r in back)
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, (r.payload or b"").decode()) for r in back)
    kind = lambda p, h: ("response", None) if h != LONG or p == 2 else ("revisit", 2)
    assert got == sorted((str(p), *kind(p, h), len((h or "").encode()), "" if kind(p, h)[1] else h or "") for p, _, h in ROWS)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_a_large_group_of_equal_pages_and_the_shuffled_way(spark, monkeypatch):
    rows = [(k, "u", LONG) for k in range(3000, 0, -1)] + [(5000 + k, "u", LONG + str(k % 7)) for k in range(50)] + [(1, "v", LONG + "0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    least = {}
    for p, _, h in rows:
        least[h] = min(p, least.get(h, p))
    want = sorted((p, least[h] if p != least[h] else -1) for p, _, h in rows)
    for most in (warc.BROADCAST_REVISITS, 0):
        monkeypatch.setattr(warc, "BROADCAST_REVISITS", most)
        assert sorted((r.page_id, -1 if r.refers_to is None else r.refers_to) for r in warc.round_trip(spark, pages).collect()) == want


def test_damaged_plain_archives_are_searched_once():
    class Counting(warc.Bytes):
        read_bytes = 0

        def read(self, n):
            part = super().read(n)
            self.read_bytes += len(part)
            return part

    f = Counting(b"".join(x[:-4] + b"~~~~" for x in records(4000, compress=False)))
    got = list(warc.salvage(warc.Source(f, len(f.data))))
    assert [bool(r["fault"]) for r in got] == [True]
    assert f.read_bytes < 40 * len(f.data)


def rows_of(data):
    return list(warc.salvage(warc.Source(warc.Bytes(data), len(data))))


def records(n=6, compress=True):
    import zlib

    out = []
    for k in range(n):
        html = f"<html>{k} WARC/1.1 " + "text " * (50 + k)
        import hashlib

        r = warc.record(k, f"http://h/{k}", html, len(html), hashlib.sha256(html.encode()).hexdigest(), None)
        if compress:
            z = zlib.compressobj(4, zlib.DEFLATED, 31)
            r = z.compress(r) + z.flush()
        out.append(r)
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_after_damage(compress):
    parts = records(compress=compress)
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    damaged = [parts[0], parts[1], bytes(bad), parts[3], parts[4][:-9], parts[5]]
    got = rows_of(b"".join(damaged))
    assert [r["page_id"] for r in got if r["fault"] is None] == [0, 1, 3, 5]
    ends = [sum(map(len, damaged[:k])) for k in range(7)]
    gaps = [(r["begin"], r["end"]) for r in got if r["fault"]]
    assert gaps == [(ends[2], ends[3]), (ends[4], ends[5])]
    # every byte is in a record or in a gap
    assert sum(r["end"] - r["begin"] for r in got) == ends[6]


def test_salvage_of_junk_heads_tails_and_cuts():
    parts = records(3)
    got = rows_of(b"junk\x1f\x8b\x08junk" + b"".join(parts) + parts[0][:40])
    assert [r.get("page_id") for r in got] == [None, 0, 1, 2, None]
    assert got[0]["begin"] == 0 and got[0]["end"] == 11
    assert rows_of(b"") == []
    assert [r["fault"] is None for r in rows_of(b"no archive at all")] == [False]


def test_salvage_inside_a_member():
    import gzip

    parts = records(8, compress=False)
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    for spoilt in (bytes(bad), parts[2][20:], parts[2][:-30]):
        got = rows_of(gzip.compress(b"".join([*parts[:2], spoilt, *parts[3:]])) + records(1)[0])
        assert [r["page_id"] for r in got if not r["fault"]] == [0, 1, 3, 4, 5, 6, 7, 0]
        assert sum(bool(r["fault"]) for r in got) == 1
    import random

    noise = [random.Random(k).randbytes(3000).hex() for k in range(40)]
    import hashlib

    whole = gzip.compress(b"".join(warc.record(k, "u", x, len(x), hashlib.sha256(x.encode()).hexdigest(), None) for k, x in enumerate(noise)))
    got = rows_of(whole[: len(whole) // 2] + records(1)[0])
    good = [r["page_id"] for r in got if not r["fault"]]
    assert good[:-1] == list(range(len(good) - 1)) and len(good) >= 19 and good[-1] == 0
    assert [bool(r["fault"]) for r in got].count(True) == 1
