"""Order checks in one pass against a plain loop, over many splits; section queries against their exploded forms."""

import random

import pytest
from pyspark.sql import functions as F

from tracklake.operators import profile, ranges, sections


def brute(rows):
    seen, previous, edge = set(), None, None
    for i, (c, s, _) in enumerate(rows):
        if c != previous and c in seen:
            return i, profile.CHROM
        if c == previous and s < edge:
            return i, profile.START
        seen.add(c)
        previous, edge = c, s
    return None


def cases():
    rng = random.Random(3)
    good = [(c, k * 3, k * 3 + 5) for c in ("x", "a", "m", "b") for k in range(100)]
    yield good
    for at in (1, 100, 399):
        swapped = list(good)
        swapped.insert(rng.randrange(at, 400), good[at - 1])
        yield swapped
    for _ in range(2):
        yield [(rng.choice("ab"), rng.randrange(50), 60) for _ in range(120)]
    yield [("a", 5, 6)] * 50 + [("b", 1, 2)] * 50 + [("a", 9, 10)]
    yield []


@pytest.mark.parametrize("batch", [7, 10_000])
def test_first_fault_equals_a_loop(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for rows in cases():
            for per in (23, 1000):
                data = [("f" if k < 180 else "g", k // per * per, k, *r) for k, r in enumerate(rows)]
                df = spark.createDataFrame(data, "file string, split long, row long, chrom string, start int, end int").coalesce(1)
                r = profile.profile(df).first()
                want = brute(rows)
                assert ((r.row, r.reason) if not r.sorted else None) == want, (per, want, r)
                assert (r["items"], r.chroms, r.total_length) == (len(rows), len({c for c, *_ in rows}), sum(e - s for _, s, e in rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_as_written(spark, tmp_path):
    rows = [("a", k, k + 1) for k in range(500)] + [("b", 0, 1), ("a", 999, 1000)]
    spark.createDataFrame(rows, "chrom string, start int, end int").coalesce(1).write.parquet(f"{tmp_path}/p")
    r = profile.profile(profile.as_written(spark, f"{tmp_path}/p", "chrom", "start", "end")).first()
    assert (r["items"], r.sorted, r.row, r.reason) == (502, False, 501, profile.CHROM) and r.file.endswith(".parquet")


def test_gathered_sections_are_bounded_and_whole(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), s := rng.randrange(50), s + rng.randrange(1, 9), float(rng.randrange(9)), rng.choice("xy")) for _ in range(500)]
    d = spark.createDataFrame(rows, "chrom string, start int, end int, score float, kind string")
    got = sections.gathered(d, "kind", most=20)
    found = got.collect()
    assert max(len(r.values) for r in found) <= 16 and all(r.starts == sorted(r.starts) for r in found)
    assert sorted(map(tuple, sections.bedgraph(got).collect())) == sorted(r[:4] for r in rows)
    assert {(r.chrom, r.kind) for r in found} == {(r[0], r[4]) for r in rows}


def test_section_queries_equal_exploded_ones(spark):
    rng = random.Random(5)
    fixed = [("a", rng.randrange(50), rng.choice([1, 3, 10]), rng.choice([1, 2, 5]), [float(k) for k in range(rng.randrange(40))]) for _ in range(30)]
    fx = spark.createDataFrame(fixed, "chrom string, start int, step int, span int, values array<float>")
    variable = [("a", rng.choice([1, 4]), (p := sorted(rng.randrange(100) for _ in range(rng.randrange(20)))), [float(k) for k in range(len(p))]) for _ in range(30)]
    vr = spark.createDataFrame(variable, "chrom string, span int, positions array<int>, values array<float>")
    graph = [("a", (p := sorted(rng.randrange(100) for _ in range(rng.randrange(20)))), [x + rng.randrange(1, 30) for x in p], [float(k) for k in range(len(p))]) for _ in range(30)]
    bg = spark.createDataFrame(graph, "chrom string, starts array<int>, ends array<int>, values array<float>")
    for lo, hi in ((0, 1000), (20, 60), (33, 34), (31, 36), (90, 95), (500, 600)):
        for rows, cut, explode in ((fx, sections.fixed_range, sections.fixed_step), (vr, sections.variable_range, sections.variable_step), (bg, sections.bedgraph_range, sections.bedgraph)):
            got = explode(cut(rows, lo, hi))
            want = ranges.range_query(explode(rows), "a", lo, hi)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
            plan = cut(rows, lo, hi)._jdf.queryExecution().optimizedPlan().toString()
            assert "Generate" not in plan
    for p in (0, 20, 33, 34, 90, 500):
        got = [r.v for r in fx.select(sections.fixed_at(p).alias("v")).collect()]
        assert got == [next((v for k, v in enumerate(x[4]) if x[1] + k * x[2] == p), None) for x in fixed]
        got = [r.v for r in vr.select(sections.variable_at(p).alias("v")).collect()]
        assert got == [next((v for q, v in zip(x[2], x[3]) if q == p), None) for x in variable]
    with pytest.raises(Exception, match="nothing begins at 500"):
        vr.select(sections.required(sections.variable_at(500), 500)).collect()
    assert fx.select(F.max(sections.fixed_at(20))).count() == 1
