"""Interval arithmetic, coverage and joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tracklake.functions import intervals as iv
from tracklake.operators import coverage, joins, pyramid, ranges, sections, summary


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start int, end int, score float")


def some(n, seed, width=300, longest=40):
    rng = random.Random(seed)
    return [(rng.choice("AB"), s := rng.randrange(width), s + rng.randrange(1, longest), float(rng.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("lo,hi,n,want", [(0, 10, 2, [(0, 5), (5, 10)]), (0, 9, 2, [(0, 5), (5, 9)]), (0, 5, 4, [(0, 1), (1, 3), (3, 4), (4, 5)])])
def test_bin_edges(spark, lo, hi, n, want):
    rows = spark.range(n).select(iv.bin_start(lo, hi, n, "id"), iv.bin_end(lo, hi, n, "id")).collect()
    assert sorted(map(tuple, rows)) == want


def test_bins_are_disjoint_and_cover(spark):
    rng = random.Random(1)
    for _ in range(5):
        lo = rng.randrange(-50, 50)
        hi = lo + rng.randrange(1, 500)
        n = rng.randrange(1, hi - lo + 1)
        edges = sorted(map(tuple, spark.range(n).select(iv.bin_start(lo, hi, n, "id"), iv.bin_end(lo, hi, n, "id")).collect()))
        assert edges[0][0] == lo and edges[-1][1] == hi and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def depth(rows):
    out = {}
    for c, s, e, _ in rows:
        for p in range(s, e):
            out[c, p] = out.get((c, p), 0) + 1
    return out


@pytest.mark.parametrize("tile", [7, 64, 1 << 18])
def test_coverage_is_exact_in_any_tiling(spark, tile):
    rows = some(80, 2)
    runs = coverage.coverage(frame(spark, rows), tile=tile).collect()
    got = {(r.chrom, p): r.depth for r in runs for p in range(r.start, r.end)}
    assert got == depth(rows) and sum(r.end - r.start for r in runs) == len(got)
    merged = coverage.merge_intervals(frame(spark, rows), tile).collect()
    assert {(r.chrom, p) for r in merged for p in range(r.start, r.end)} == set(got)


def swept(rows):
    """The sweep that looks up at ends only, step by step."""
    out = []
    for c in {r[0] for r in rows}:
        events = sorted([(s, 1) for x, s, e, _ in rows if x == c] + [(e, 0) for x, s, e, _ in rows if x == c])
        now, left = 0, None
        for pos, begins in events:
            if begins:
                if now == 0:
                    left = pos
                now += 1
            else:
                if pos > left:
                    out.append((c, left, pos, now))
                left, now = pos, now - 1
    return sorted(out)


@pytest.mark.parametrize("rows", [[], [("A", 0, 100, 1.0), ("A", 50, 150, 1.0)], [("A", 0, 10, 1.0)] * 2, [("A", 0, 10, 1.0), ("A", 10, 20, 1.0)], [("A", 0, 30, 1.0), ("A", 10, 20, 1.0)], some(60, 3)])
def test_end_event_sweep(spark, rows):
    for tile in (16, 1 << 18):
        got = sorted((r.chrom, r.start, r.end, r.depth) for r in coverage.coverage(frame(spark, rows), "end_events", tile).collect())
        assert got == swept(rows)


@pytest.mark.parametrize("mode", ["overlaps", "contains"])
def test_interval_join(spark, mode):
    a, b = some(60, 4), some(60, 5, longest=9)
    got = sorted((r.l_chrom, r.l_start, r.l_end, r.r_start, r.r_end) for r in joins.interval_join(frame(spark, a), frame(spark, b), mode, 16).collect())
    fits = (lambda x, y: x[1] < y[2] and y[1] < x[2]) if mode == "overlaps" else (lambda x, y: y[1] >= x[1] and y[2] <= x[2])
    assert got == sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and fits(x, y))


def test_interval_join_of_very_long_intervals(spark):
    a = some(40, 11) + [("A", 0, 2_000_000_000, 1.0), ("A", 5, 70_000, 1.0), ("B", 3, 3, 1.0)]
    b = some(40, 12, longest=9) + [("A", 10, 1_900_000_000, 1.0), ("A", 1_999_999_990, 1_999_999_999, 1.0)]
    for tile in (16, None):
        got = sorted((r.l_chrom, r.l_start, r.l_end, r.r_start, r.r_end) for r in joins.interval_join(frame(spark, a), frame(spark, b), tile=tile).collect())
        assert got == sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and x[1] < y[2] and y[1] < x[2])
    assert joins.interval_join(frame(spark, []), frame(spark, [])).count() == 0


def totals(a, b, fits, of):
    """For each row of a that meets any of b: how many, and what they give in all."""
    met = [(x, [of(x, y) for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and fits(x, y)]) for x in a]
    return sorted((*x[:3], len(found), sum(found)) for x, found in met if found)


def test_overlap_totals(spark):
    a = some(60, 4) + [("A", 0, 2_000_000_000, 1.0), ("A", -70, 9, 1.0), ("B", 3, 3, 1.0), ("Z", 0, 9, 1.0)]
    b = some(60, 5, longest=9) + [("A", -9, 1_900_000_000, 1.0), ("B", 0, 8, 1.0), ("B", 0, 8, 1.0)]
    got = sorted((r.chrom, r.start, r.end, r.n, r.shared) for r in joins.overlap_totals(frame(spark, a), frame(spark, b)).collect())
    assert got == totals(a, b, lambda x, y: x[1] < y[2] and y[1] < x[2], lambda x, y: min(x[2], y[2]) - max(x[1], y[1]))
    assert joins.overlap_totals(frame(spark, []), frame(spark, b)).count() == joins.overlap_totals(frame(spark, a), frame(spark, [])).count() == 0


def test_totals_where_every_interval_meets_every_other(spark):
    # ten thousand million pairs, which a join would have to make
    d = spark.range(100_000).selectExpr("'A' AS chrom", "CAST(id AS INT) AS start", "CAST(id + 200000 AS INT) AS end", "CAST(1 AS FLOAT) AS score")
    row = joins.overlap_totals(d, d).selectExpr("min(n)", "max(n)", "sum(shared)").first()
    assert tuple(row) == (100_000, 100_000, sum((200_000 - k) * (100_000 - k) * (2 if k else 1) for k in range(100_000)))


def test_contained_totals(spark):
    a = some(60, 4) + [("A", 0, 2_000_000_000, 1.0), ("A", -70, 9, 1.0), ("A", 0, 2_000_000_000, 2.0), ("B", 3, 3, 1.0), ("Z", 0, 9, 1.0)]
    b = some(60, 5, longest=9) + [("A", -70, -60, 3.0), ("A", 5, 1_900_000_000, 2.5), ("B", 0, 8, 1.0), ("B", 0, 8, 1.0)]
    got = sorted((r.chrom, r.start, r.end, r.n, r.total) for r in joins.contained_totals(frame(spark, a), frame(spark, b)).collect())
    assert got == totals(a, b, lambda x, y: y[1] >= x[1] and y[2] <= x[2], lambda x, y: y[3])
    inf = joins.contained_totals(frame(spark, [("A", 0, 9, 0.0), ("A", 0, 5, 0.0)]), frame(spark, [("A", 1, 2, 4.0), ("A", 6, 7, float("inf"))]))
    assert sorted((r.end, r.n, r.total) for r in inf.collect()) == [(5, 1, 4.0), (9, 2, float("inf"))]
    assert joins.contained_totals(frame(spark, []), frame(spark, b)).count() == joins.contained_totals(frame(spark, a), frame(spark, [])).count() == 0


def test_join_plan_is_an_equi_join(spark):
    d = frame(spark, some(10, 6)).hint("shuffle_merge")
    plan = joins.interval_join(d, frame(spark, some(10, 7)))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_summaries(spark):
    nan = float("nan")
    rows = [("A", 0, 10, 1.0), ("A", 5, 15, 3.0), ("A", 18, 20, nan)]
    d = frame(spark, rows)
    got = {r.bin: r for r in summary.summarize(d, "A", 0, 30, 3).collect()}
    assert (got[0]["count"], got[0]["min"], got[0]["max"], got[0]["sum"], got[0]["sum_squares"]) == (15, 1.0, 3.0, 25.0, 55.0)
    assert got[1]["min"] != got[1]["min"] and got[1]["max"] != got[1]["max"]
    assert (got[2]["count"], got[2]["min"], got[2]["max"]) == (0, float("inf"), float("-inf"))
    with pytest.raises(KeyError):
        summary.summarize(d, "Z")
    with pytest.raises(ValueError):
        summary.summarize(d, "A", 0, 5, 6)
    with pytest.raises(ValueError):
        ranges.range_query(d, "A", 5, 5)
    assert summary.summarize_all(d, 50).count() == 0  # more bins than positions


def test_zoom(spark):
    levels = [3911 * 10**k for k in range(4)]
    assert pyramid.pick(levels, 5_000_000) == 3_911_000 and pyramid.pick(levels, 1) is None and pyramid.pick(levels, 1000) is None
    rows = some(200, 8)
    d = frame(spark, rows)
    top = pyramid.pyramid(d, 10, 3).where("reduction = 160").agg(F.sum("count"), F.sum("sum")).first()
    assert tuple(top) == (sum(e - s for _, s, e, _ in rows), sum(v * (e - s) for _, s, e, v in rows))
    # aligned bins from the pyramid equal those from the rows
    p = pyramid.pyramid(d, 10, 2)
    exact = {(r.chrom, r.bin): (r["count"], r["sum"]) for r in summary.spread(d, 0, 320, 4).groupBy("chrom", "bin").agg(*summary.aggregates("score", "overlap")).collect()}
    zoomed = {(r.chrom, r.bin): (r["count"], r["sum"]) for r in pyramid.summarize(d, p, [10, 40], 0, 320, 4).collect()}
    assert zoomed == exact


def test_sections(spark):
    d = frame(spark, [("A", 1, 2, 1.0), ("A", 1, 2, 2.0), ("A", 1, 3, 4.0)])
    assert sorted((r.end, r.score) for r in sections.coalesce_bedgraph(d).collect()) == [(2, 3.0), (3, 4.0)]
    assert [(r.end, r.score) for r in sections.coalesce_variable(d).collect()] == [(3, 7.0)]
    s = spark.createDataFrame([("A", 400600, 100, 5, [11.0, 22.0, 33.0])], "chrom string, start int, step int, span int, values array<double>")
    assert sorted((r.start, r.end, r.score) for r in sections.fixed_step(s).collect()) == [(400600, 400605, 11.0), (400700, 400705, 22.0), (400800, 400805, 33.0)]
    runs = sections.consecutive(spark.createDataFrame([(1, k, c) for k, c in enumerate("aabba")], "u int, k int, c string"), "u", "k", "c")
    assert sorted((r.first, r.c, r["size"]) for r in runs.collect()) == [(0, "a", 2), (2, "b", 2), (4, "a", 1)]
    cut = sections.splice(frame(spark, some(100, 9)).withColumn("section", F.lit(1)), most=7)
    assert max(r["count"] for r in cut.groupBy("chrom", "section", "part").count().collect()) == 7 and cut.count() == 100


def test_ranks_across_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice(["a", "b", None]), rng.randrange(50)) for k in range(400)]
    d = spark.createDataFrame(rows, "u int, k int, c string, start int")
    runs, violations, slots = {}, [], {}
    for u in (1, 2, None):
        own, run, before = [r for r in rows if r[0] == u], 0, None
        for n, r in enumerate(own):
            run += before is None or before[2] is None or before[2] != r[2]
            runs.setdefault((u, run, r[2]), []).append(r[1])
            slots.setdefault((u, n // 7), []).append(r[1])
            if before is not None and r[3] < before[3]:
                violations.append((*r, before[3]))
            before = r
    key = lambda x: repr(x)
    assert sorted(((r.u, r.run, r.c, r.first, r["size"]) for r in sections.consecutive(d, "u", "k", "c").collect()), key=key) == sorted(((*k, min(v), len(v)) for k, v in runs.items()), key=key)
    assert sorted((tuple(r) for r in sections.order_violations(d, "k", "u").collect()), key=key) == sorted(violations, key=key)
    got = sections.fixed_slots(d.select("u", F.col("k").alias("start"), F.col("k").alias("end")), 7, "u", ("start",)).collect()
    assert sorted(((r.u, r.slot, r.start, r["size"]) for r in got), key=key) == sorted(((*k, min(v), len(v)) for k, v in slots.items()), key=key)
    assert sections.consecutive(d.limit(0), "u", "k", "c").count() == 0


def test_range_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, some(50, 10)).write.parquet(f"{tmp_path}/t")
    plan = ranges.range_query(spark.read.parquet(f"{tmp_path}/t"), "A", 5, 50).select("score")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(chrom,A)" in plan and "GreaterThanOrEqual(start,5)" in plan and "LessThanOrEqual(end,50)" in plan
