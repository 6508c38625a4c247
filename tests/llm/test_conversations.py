"""Conversation repair against an independent search, its SQL, and small batches against large ones."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import conversations  # noqa: E402

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FITS = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """{conv_id: rows after damage in order}"""
    out = {}
    for c, t, role, text in rows:
        mine = out.setdefault(c, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [] if k == 0 else [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for c in out:
        out[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows, found):
    """Cheapest (cost, audit, lines) by a best-first search over prefixes that the grammar allows."""
    can = lambda x: any(FITS.fullmatch(x + more) for more in ("", "a", "ua"))
    heap, closed = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, said, lines = heapq.heappop(heap)
        state = (k, said[-1:], len(said) % 2 if said[:1] != "s" else (len(said) + 1) % 2, said[:1] == "s" and len(said) == 1)
        if k == len(rows) and FITS.fullmatch(said):
            return cost, audit, lines
        if state in closed:
            continue
        closed.add(state)
        moves = [(5, "I", k, r[0], f"{r}:") for r in ("user", "assistant")]
        if k < len(rows):
            _, role, text = rows[k]
            moves.append((2, "D", k + 1, "", None))
            if found[k] in (None, "truncated"):
                more = 5 if found[k] else 0
                moves.append((more, "K", k + 1, role[:1], f"{role}:{text}"))
                moves += [(1 + more, "R", k + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for c, x, at, letter, line in moves:
            if can(said + letter):
                heapq.heappush(heap, (cost + c, audit + x, at, said + letter, lines if line is None else (*lines, line)))
    raise AssertionError


def brute(rows):
    out = []
    for c, mine in damage(rows).items():
        found = faults(mine)
        cost, audit, lines = search(mine, found)
        turns = {t for t, *_ in mine if t is not None}
        gap = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((c, gap, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed, convs, most, roles=("user", "assistant", "user", "assistant", "system", "tool", None, "", "sys", "üser")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!  ", "why?\n", "open end", "", " \x0b", None, "Same again.", "\x1c", "é。", "a.b"]
    rows = []
    for c in range(convs):
        role = ("user", "assistant") if rng.random() < 0.5 else roles
        rows += [(c, rng.choice([None, t, t, t, t + rng.randrange(3)]), role[t % 2] if rng.random() < 0.6 else rng.choice(role), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(5)} of it.") for t in range(rng.randrange(1, most))]
    return rows + [(None, 0, "user", "No conversation."), (None, None, "assistant", "None.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, audit string")


def got(df):
    return sorted((tuple(r[c.split()[0]] for c in conversations.COLUMNS.split(", ")) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"segment": 2}, {"batch_rows": 3, "segment": 2}, {"batch_bytes": 1}])
def test_equals_search(spark, options):
    rows = table(4, 150, 12)
    assert got(conversations.repair(conversations.damaged(frame(spark, rows)), **options)) == brute(rows)


def test_long_conversations_in_pieces(spark):
    rng = random.Random(9)
    rows = [(k, t, rng.choice(["user", "assistant"]), f"{rng.randrange(300)} of it" + rng.choice([".", ""])) for k in range(3) for t in range(400)]
    rows += [(7, 0, "user", "word " * 25_000 + "."), (7, 1, "assistant", "Short.")]
    want = brute(rows)
    for options in ({}, {"batch_rows": 37, "segment": 5}):
        assert got(conversations.repair(conversations.damaged(frame(spark, rows)), **options)) == want


def test_sql_agrees(spark, tmp_path):
    rows = table(11, 60, 9)
    df = frame(spark, rows)
    df.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/c")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    columns = ", ".join(x.split()[0] for x in conversations.COLUMNS.split(", "))
    assert sorted(c.execute(f"SELECT {columns} FROM ({conversations.ORACLE})").fetchall(), key=str) == brute(rows)


def test_without_damage_and_empty_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (2, 0, "user", "Hm"), (3, 5, "assistant", "A."), (3, 9, "user", "B.")]
    df = frame(spark, rows)
    out = {r.conv_id: (r.gaps, r.cost, r.audit) for r in conversations.repair(conversations.whole(df)).collect()}
    assert out == {1: (0, 0, "KKK"), 2: (0, 2, "D"), 3: (3, 2, "RR")}
    assert conversations.repair(conversations.damaged(df.limit(0))).count() == 0
