"""Conversation structure repair: the cheapest edits that make the roles fit `(s?(ua)+)?`, by dynamic programming in DuckDB.

Rows are damaged (or not), dealt by conv_id and sorted by Spark; faults, adjacent roles and turn numbers are judged there by
windows over the same deal. Each task takes its conversations in batches through DuckDB. A recursive
query advances one turn for all conversations of the batch at once and keeps, for each state of the grammar, the
minimum cost and its audit: the initials of the edits in order. Of edits of one cost the ASCII-least audit is kept, which is
safe step by step: audits of one cost after the same turns cannot be prefixes of each other, since letters that are
more would be inserts, and those cost.

States are 0 (nothing yet), S (after the system turn), U (an answer is due) and A (whole pairs). Long conversations are cut into
SEGMENT turns that walk side by side from every state; a second recursion joins a segment a step. So the depth of the recursions
and the audits they copy stay small. A conversation longer than a batch is taken in several: costs, audits
and SHA-256 states for each grammar state go from one to the next, so memory is bounded by a batch and four audits.

Order of rows: turn, nulls first, then role, then text, by code points; copies are adjacent in it. Defined cases: null roles and
texts are one space, so a null text is blank and a null role fits no grammar state; an empty role has no initial, and
keeping it changes no state; a null conv_id is one conversation; repeated rows are duplicates by the rule; a conversation that
loses all rows has zeros, an empty audit and the hash of the empty string. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
#: Costs of the edits, and what keeping or reroling a truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and bytes of text of a batch, and turns of a segment.
ROWS, BYTES, SEGMENT = 1 << 14, 1 << 25, 64
START, SYSTEM, USER, PAIRS = "0", "S", "U", "A"
#: What each role initial does to each state.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, PAIRS: USER}, "a": {USER: PAIRS}}
#: Inserts that are worth something before the next row.
INSERTS = {START: (("I", USER), ("II", PAIRS)), SYSTEM: (("I", USER), ("II", PAIRS)), USER: (("I", PAIRS),), PAIRS: (("I", USER),)}

COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in COLUMNS.split(", ")])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live after damage; a dropped row stays as one that does not live.

    crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its role user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 0, "").when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") != 0).alias("live"), F.explode(copies).alias("copy")).drop("copy")


def whole(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of damaged()."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", shown("role"), shown("text"), F.lit(True).alias("live"))


def judged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, live) dealt by conv_id and in order, with init, fault, illegal and fresh (a turn number not met before)."""
    dealt = rows.repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy("live", "turn", "role", "text")
    alike = Window.partitionBy("conv_id", "live", "role", "text").orderBy("turn")
    seen = dealt.withColumn("again", F.row_number().over(alike) > 1).withColumn("init", F.substring("role", 1, 1))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    open_end = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(open_end, "truncated")
    before = lambda c: F.lag(F.when(F.col("live"), F.col(c))).over(order)
    placed = seen.withColumns({"fault": fault, "pair": F.concat(before("init"), "init"), "last": before("turn")})
    illegal = F.col("live") & ~F.coalesce(F.col("pair").isin("su", "ua", "au"), F.lit(True))
    fresh = F.col("live") & F.col("turn").isNotNull() & ~F.coalesce(F.col("last") == F.col("turn"), F.lit(False))
    placed = placed.sortWithinPartitions("conv_id", "live", "turn", "role", "text")
    return placed.select("conv_id", F.when(F.col("live"), F.col("turn")).alias("turn"), "role", "text", "live", "init", "fault", illegal.alias("illegal"), fresh.alias("fresh"))


def edits() -> list[tuple]:
    """(init, from, to, letter, letters, cost): one row's edit and the inserts after it; init null fits every row."""
    found = []
    for state in MOVES["u"] | MOVES["a"]:
        found.append((None, state, state, "D", DELETE))
        found.append(("", state, state, "K", 0))
        for init, to in MOVES.items():
            if state in to:
                found.append((init, state, to[state], "K", 0))
                if init != "s":
                    found.append((None, state, to[state], "R", REROLE))
    return [(i, a, c, x, x + more, cost + INSERT * len(more)) for i, a, b, x, cost in found for more, c in (("", b), *INSERTS[b])]


VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in e) + ")" for e in edits())
BEGIN = ", ".join(f"('{START}', '{s}', '{x}', {INSERT * len(x)})" for x, s in (("", START), *INSERTS[START]))

#: The states that a segment may begin in, and what stands before its first row: inserts, where the conversation begins there.
WALK = f"""
WITH RECURSIVE edits(init, src, dst, letter, letters, cost) AS (VALUES {VALUES}),
  begin(entry, state, a, c) AS (VALUES {BEGIN}),
  parts AS (SELECT conv, seg, max(k) AS size FROM turns GROUP BY conv, seg),
  walk(conv, seg, k, entry, state, best) AS (
    SELECT conv, seg, CAST(0 AS BIGINT), entry, state, {{'c': CAST(c AS BIGINT), 'a': a}} FROM parts, begin WHERE seg = 0 AND conv <> $open
    UNION ALL SELECT conv, seg, CAST(0 AS BIGINT), s, s, {{'c': CAST(0 AS BIGINT), 'a': ''}} FROM parts, (VALUES ('0'), ('S'), ('U'), ('A')) v(s) WHERE seg > 0 OR conv = $open
    UNION ALL
    SELECT w.conv, w.seg, w.k + 1, w.entry, e.dst,
      min({{'c': w.best.c + e.cost + CASE WHEN t.fault = 'truncated' AND e.letter <> 'D' THEN {TRUNCATED} ELSE 0 END, 'a': w.best.a || e.letters}})
    FROM walk w JOIN turns t ON t.conv = w.conv AND t.seg = w.seg AND t.k = w.k + 1
      JOIN edits e ON e.src = w.state AND (e.init IS NULL OR e.init = t.init) AND (e.letter = 'D' OR t.fault IS NULL OR t.fault = 'truncated')
    GROUP BY w.conv, w.seg, w.k, w.entry, e.dst)
SELECT conv, seg, entry, state, best FROM walk JOIN parts USING (conv, seg) WHERE k = size"""

JOIN = """
WITH RECURSIVE lasts AS (SELECT conv, max(seg) AS seg FROM hops GROUP BY conv),
  path(conv, seg, entry, state, best) AS (
    SELECT conv, seg, entry, state, best FROM hops WHERE seg = 0
    UNION ALL
    SELECT p.conv, p.seg + 1, p.entry, h.state, min({'c': p.best.c + h.best.c, 'a': p.best.a || h.best.a})
    FROM path p JOIN hops h ON h.conv = p.conv AND h.seg = p.seg + 1 AND h.entry = p.state GROUP BY p.conv, p.seg, p.entry, h.state)
SELECT conv, entry, state, best.c AS cost, best.a AS audit FROM path JOIN lasts USING (conv, seg)"""

#: The repaired text of each chosen path: letters meet rows in order, and roles that the letters leave open alternate.
REPAIR = """
WITH letters AS (SELECT path, conv, entry, unnest(string_split(audit, '')) AS x, unnest(range(1, length(audit) + 1)) AS p FROM chosen WHERE audit <> ''),
  placed AS (SELECT *, CASE WHEN x <> 'I' THEN sum(CASE WHEN x <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY p) END AS n FROM letters),
  rows AS (SELECT l.*, t.role, coalesce(t.text, '') AS text, CASE WHEN x = 'D' OR (x = 'K' AND init IN ('', 's')) THEN 0 ELSE 1 END AS one
    FROM placed l LEFT JOIN turns t ON t.conv = l.conv AND t.n = l.n),
  ranked AS (SELECT *, CASE WHEN entry = 'U' THEN 1 ELSE 0 END + sum(one) OVER (PARTITION BY path ORDER BY p) - one AS before FROM rows),
  said AS (SELECT path, p, CASE WHEN x = 'K' THEN role WHEN before % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text AS line FROM ranked WHERE x <> 'D')
SELECT c.path, c.conv, c.state, c.cost, c.audit, coalesce(s.whole, '') AS whole, s.whole IS NOT NULL AS any
FROM chosen c LEFT JOIN (SELECT path, string_agg(line, chr(10) ORDER BY p) AS whole FROM said GROUP BY path) s ON s.path = c.path"""

SUMS = """
SELECT conv, min(turn) AS low, max(turn) AS high, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) AS BIGINT) AS turns, CAST(sum(CASE WHEN live AND fault = 'blank' THEN 1 ELSE 0 END) AS BIGINT) AS blank,
  CAST(sum(CASE WHEN live AND fault = 'duplicate' THEN 1 ELSE 0 END) AS BIGINT) AS duplicate, CAST(sum(CASE WHEN live AND fault = 'truncated' THEN 1 ELSE 0 END) AS BIGINT) AS truncated, CAST(sum(CASE WHEN illegal THEN 1 ELSE 0 END) AS BIGINT) AS illegal
FROM all_rows GROUP BY conv"""


class Open:
    """A conversation of which more rows may come: its sums, and for each state the cost, the audit, the hash and whether lines were written."""

    def __init__(self, conv_id):
        self.conv_id, self.low, self.high = conv_id, None, None
        self.counts = [0] * 5
        self.states = {START: (0, "", hashlib.sha256(), False)} | {s: (INSERT * len(x), x, None, True) for x, s in INSERTS[START]}

    def add(self, sums: tuple) -> None:
        low, high, *counts = sums
        self.low = low if self.low is None else self.low if low is None else min(self.low, low)
        self.high = high if self.high is None else self.high if high is None else max(self.high, high)
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]

    def row(self) -> tuple:
        cost, audit, sha, _ = min((self.states[s][:2] + (self.states[s][2], s) for s in (START, PAIRS) if s in self.states), key=lambda x: x[:2])
        return (self.conv_id, gaps(self.low, self.high, self.counts[0]), *self.counts[1:], cost, audit, sha.hexdigest())


def gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def repair_batches(rows: int = ROWS, size: int = BYTES, segment: int = SEGMENT):
    """The work of a task over judged rows, sorted by conversation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        held, still = [], None
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                held.append(batch.slice(lo, rows))
                if sum(b.num_rows for b in held) < rows and sum(b.get_total_buffer_size() for b in held) < size:
                    continue
                chunk = pa.Table.from_batches(held).combine_chunks()
                cut = starts_of(chunk)[-1]
                if cut:
                    out, still = repaired(db, chunk.slice(0, cut), still, False, segment)
                    yield out
                    held = chunk.slice(cut).to_batches()
                else:
                    out, still = repaired(db, chunk, still, True, segment)
                    yield out
                    held = []
        if held or still:
            out, _ = repaired(db, pa.Table.from_batches(held).combine_chunks() if held else None, still, False, segment)
            yield out
        db.close()

    return work


def starts_of(chunk: pa.Table) -> np.ndarray:
    """Where conversations begin in a chunk of at least one row."""
    ids = chunk.column("conv_id").combine_chunks()
    value, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])]))


def repaired(db, chunk: pa.Table | None, still: Open | None, more: bool, segment: int) -> tuple[pa.RecordBatch, Open | None]:
    """Result rows of the conversations that end in the chunk; more: its last (and only) one may go on in the next."""
    out = []
    if chunk is None or still is not None and chunk.column("conv_id")[0].as_py() != still.conv_id:
        out, still = [still.row()] if still else [], None
    if chunk is not None:
        at = starts_of(chunk)
        ids = chunk.column("conv_id").take(pa.array(at)).to_pylist()
        if more and still is None:
            still = Open(ids[0])
        live = chunk.column("live").to_numpy()
        conv = np.repeat(np.arange(len(at)), np.diff(np.append(at, chunk.num_rows)))
        n = np.cumsum(live) - np.repeat(np.concatenate([[0], np.cumsum(live)])[at], np.diff(np.append(at, chunk.num_rows)))
        every = chunk.append_column("conv", pa.array(conv)).append_column("n", pa.array(n))
        every = every.append_column("seg", pa.array((n - 1) // segment)).append_column("k", pa.array((n - 1) % segment + 1))
        db.register("all_rows", every)
        db.register("turns", every.filter(every.column("live")).select(["conv", "seg", "k", "n", "init", "role", "text", "fault"]))
        sums = {r[0]: r[1:] for r in db.execute(SUMS).fetchall()}
        hops = db.execute(WALK, {"open": 0 if still else -1}).to_arrow_table()
        db.register("hops", hops)
        paths = db.execute(JOIN).fetchall()
        chosen = []
        for c, entry, state, cost, audit in paths:
            if still is None or c:
                if state in (START, PAIRS):
                    chosen.append((c, entry, state, cost, audit))
        best: dict = {}
        for x in chosen:
            if x[0] not in best or (x[3], x[4]) < (best[x[0]][3], best[x[0]][4]):
                best[x[0]] = x
        if still is not None:
            ends: dict = {}
            for c, entry, state, cost, audit in paths:
                if c == 0 and entry in still.states:
                    x = (still.states[entry][0] + cost, still.states[entry][1] + audit, entry, audit)
                    if state not in ends or x[:2] < ends[state][:2]:
                        ends[state] = x
            for state, (cost, _, entry, audit) in ends.items():
                best[(0, state)] = (0, entry, state, cost, audit)
        keys = list(best)
        names = ["conv", "entry", "state", "cost", "audit"]
        columns = list(zip(*best.values(), strict=True)) if best else [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        db.register("chosen", pa.table([pa.array(range(len(keys)), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["path", *names]))
        texts = {keys[r[0]]: r for r in db.execute(REPAIR).fetchall()}
        if still is not None:
            still.add(sums[0])
            if ends:
                fresh = {}
                for state, (cost, audit, entry, _) in ends.items():
                    _, _, sha, written = still.states[entry]
                    sha, text, any_ = sha.copy() if sha else opened(still.states[entry][1]), texts[(0, state)][5], texts[(0, state)][6]
                    sha.update((("\n" if written and any_ else "") + text).encode())
                    fresh[state] = (cost, audit, sha, written or any_)
                still.states = fresh
            if not more:
                out.append(still.row())
        for c, conv_id in enumerate(ids):
            if c in sums and not (still is not None and c == 0):
                low, high, turns, *counts = sums[c]
                x = texts.get(c)
                cost, audit, text = (x[3], x[4], x[5]) if x else (0, "", "")
                out.append((conv_id, gaps(low, high, turns), *counts, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
        for name in ("all_rows", "turns", "hops", "chosen"):
            db.unregister(name)
        if not more:
            still = None
    columns = list(zip(*out, strict=True)) if out else [[]] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA), still


def opened(inserts: str):
    """The hash of what inserts write before the first row."""
    return hashlib.sha256("\n".join(("user:", "assistant:")[k % 2] for k in range(len(inserts))).encode())


def repair(rows: DataFrame, batch_rows: int = ROWS, batch_bytes: int = BYTES, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows (damaged or whole)."""
    return judged(rows).mapInArrow(repair_batches(batch_rows, batch_bytes, segment), COLUMNS)


#: crc32 of a text whose characters are ASCII, and the whole query, in DuckDB's SQL.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
ORACLE = f"""
WITH RECURSIVE edits(init, src, dst, letter, letters, cost) AS (VALUES {VALUES}),
  begin(entry, state, a, c) AS (VALUES {BEGIN}),
  named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
  coded AS (SELECT *, {CRC} % 20 AS k FROM named),
  hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, substr(role, 1, 1) AS init FROM hurt),
  marked AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{SPACE}]*\\z') THEN 'truncated' END AS fault, lag(init) OVER (PARTITION BY conv_id ORDER BY n) || init AS pair FROM ordered),
  sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS size FROM marked GROUP BY conv_id),
  walk(conv_id, n, state, best) AS (
    SELECT conv_id, CAST(0 AS BIGINT), state, {{'c': CAST(c AS BIGINT), 'a': a}} FROM sums, begin
    UNION ALL
    SELECT t.conv_id, t.n, e.dst, min({{'c': w.best.c + e.cost + CASE WHEN t.fault = 'truncated' AND e.letter <> 'D' THEN {TRUNCATED} ELSE 0 END, 'a': w.best.a || e.letters}})
    FROM walk w JOIN marked t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1
      JOIN edits e ON e.src = w.state AND (e.init IS NULL OR e.init = t.init) AND (e.letter = 'D' OR t.fault IS NULL OR t.fault = 'truncated')
    GROUP BY t.conv_id, t.n, e.dst),
  chosen AS (SELECT s.conv_id, any_value(s.size) AS size, min(best) AS best FROM walk w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.size = w.n WHERE state IN ('{START}', '{PAIRS}') GROUP BY s.conv_id),
  letters AS (SELECT conv_id, unnest(string_split(best.a, '')) AS x, unnest(range(1, length(best.a) + 1)) AS p FROM chosen WHERE best.a <> ''),
  placed AS (SELECT *, CASE WHEN x <> 'I' THEN sum(CASE WHEN x <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) END AS n FROM letters),
  met AS (SELECT l.conv_id, x, p, role, coalesce(text, '') AS text, CASE WHEN x = 'D' OR (x = 'K' AND init IN ('', 's')) THEN 0 ELSE 1 END AS one FROM placed l LEFT JOIN marked t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.n = l.n),
  ranked AS (SELECT *, sum(one) OVER (PARTITION BY conv_id ORDER BY p) - one AS before FROM met),
  said AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN before % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM ranked WHERE x <> 'D' GROUP BY conv_id)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN said x ON x.conv_id IS NOT DISTINCT FROM d.conv_id"""
