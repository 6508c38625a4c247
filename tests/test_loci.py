"""Loci batches against plain loops, in many tilings, and what a wide locus costs."""

import math
import random

import pytest

from tracklake.operators import loci


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start int, end int, score float")


def some(n, seed, width=3000, longest=60):
    rng = random.Random(seed)
    return [(rng.choice("AB"), s := rng.randrange(width), s + rng.randrange(0, longest), float(rng.randrange(9))) for _ in range(n)]


def edge(lo, hi, n, k):
    return min(math.floor(lo + k * ((hi - lo) / n) + 0.5), hi)


def brute(rows, asked, n):
    sizes = {c: max(e for x, s, e, _ in rows if x == c and s < e) for c in {r[0] for r in rows}}
    out = {}
    for key, chrom, lo, hi in asked:
        hi = hi or sizes[chrom]
        for b in range(n):
            bs, be = edge(lo, hi, n, b), edge(lo, hi, n, b + 1)
            count, least, most, total, squares = 0, math.inf, -math.inf, 0.0, 0.0
            for c, s, e, v in rows:
                ov = min(e, be) - max(s, bs)
                if c == chrom and ov > 0 and s < e:
                    count, total, squares = count + ov, total + v * ov, squares + v * v * ov
                    least, most = (math.nan, math.nan) if math.isnan(v) or math.isnan(least) else (min(least, v), max(most, v))
            out[key, b] = (count, least, most, total, squares)
    return out


def same(a, b):
    return a.keys() == b.keys() and all(repr(a[k]) == repr(b[k]) for k in a)


@pytest.mark.parametrize("width,bins", [(None, 10), (1, 3), (7, 1), (64, 10), (10_000, 4)])
def test_equals_loops(spark, width, bins):
    rows = some(300, 3)
    rng = random.Random(4)
    asked = [(k, rng.choice("AB"), s := rng.randrange(2500), s + rng.choice([10, 17, 130, 900, 2900])) for k in range(40)] + [(90, "A", 0, 0), (91, "B", 2000, None), (92, "A", 5, 15), (92, "A", 5, 15)][:3]
    got = loci.summarize_loci(loci.index(frame(spark, rows), width=width), spark.createDataFrame(asked, "id long, chrom string, start int, end int"), bins)
    assert same({(r.id, r.bin): (r["count"], r.min, r.max, r.sum, r.sum_squares) for r in got.collect()}, brute(rows, asked, bins))


def test_nan_and_infinite_values_stay_in_their_bins(spark):
    rows = [("A", 0, 500, 1.0), ("A", 600, 610, math.nan), ("A", 900, 950, math.inf), ("A", 990, 1000, 2.0)]
    asked = [(1, "A", 0, 1000), (2, "A", 0, 590), (3, "A", 700, 1000)]
    got = loci.summarize_loci(loci.index(frame(spark, rows)), spark.createDataFrame(asked, "id long, chrom string, start int, end int"), 10)
    assert same({(r.id, r.bin): (r["count"], r.min, r.max, r.sum, r.sum_squares) for r in got.collect()}, brute(rows, asked, 10))


def test_a_wide_locus_costs_no_more_than_the_logarithm_of_its_width(spark):
    source = loci.index(frame(spark, [("A", k * 10, k * 10 + 10, 1.0) for k in range(20_000)]), width=8)
    asked = spark.createDataFrame([(w, "A", 3, 3 + w) for w in (100, 1000, 10_000, 100_000, 199_000)], "id long, chrom string, start int, end int")
    bins = loci.bins_of(asked, source.sizes, 1)
    nodes = {r.id: r["count"] for r in loci.cover(bins, source.width, source.depth).groupBy("id").count().collect()}
    edges = loci.edge_parts(bins, source.width).groupBy("id").count().collect()
    assert all(n <= 2 * loci.FAN * (1 + math.log(w / 8, loci.FAN)) for w, n in nodes.items())
    assert all(r["count"] <= 2 for r in edges)
    got = loci.summarize_loci(source, asked).collect()
    assert {r.id: (r["count"], r.sum) for r in got} == {w: (w, float(w)) for w in (100, 1000, 10_000, 100_000, 199_000)}


def test_faults_and_empty_tables(spark):
    source = loci.index(frame(spark, some(20, 1)))
    ask = lambda *rows: spark.createDataFrame(list(rows), "id long, chrom string, start int, end int")
    for bad, said in ((1, "Z", 0, 10), "unknown chromosome"), ((1, "A", 10, 10), "below end"), ((1, "A", 0, 3), "more bins"):
        with pytest.raises(Exception, match=said):
            loci.summarize_loci(source, ask(bad), 5).collect()
    assert loci.summarize_loci(source, ask((1, "A", 0, 9)).limit(0), 5).count() == 0
    assert loci.summarize_loci(loci.index(frame(spark, [])), ask((1, "A", 0, 9)).limit(0)).count() == 0


def test_ranges_take_their_own_levels_and_prune_the_others(spark, tmp_path):
    from tracklake.operators import pyramid

    rows = frame(spark, some(400, 8))
    path = f"file://{tmp_path}/levels"
    pyramid.pyramid(rows, 10, 4, path=path)
    source, levels = loci.index(rows), [10, 40, 160, 640]
    asked = spark.createDataFrame([(1, "A", 0, 3000, 2), (2, "A", 17, 2900, 30), (3, "B", 0, 2000, 100), (4, "B", 3, 33, 10), (5, "B", 100, 3000, 900)], "id long, chrom string, start int, end int, n int")
    got = pyramid.summarize_ranges(source, path, levels, asked)
    taken = {(r.id, r.reduction) for r in got.select("id", "reduction").distinct().collect()}
    assert taken == {(1, 640), (2, 40), (3, 10), (4, None), (5, None)}
    assert {r.id: r["count"] for r in got.groupBy("id").count().collect()} == {1: 2, 2: 30, 3: 100, 4: 10, 5: 900}
    one = pyramid.summarize_ranges(source, path, levels, asked.where("id = 2"))
    scans = [x for x in one._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    assert any("reduction" in x and "40" in x for x in scans)
    parts = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in parts and "reduction" in parts[parts.index("PartitionFilters: [") :]
    # a level's bucket sums agree with the rows where bins and buckets have the same edges
    even = spark.createDataFrame([(7, "A", 0, 2560, 2)], "id long, chrom string, start int, end int, n int")
    a = {r.bin: (r["count"], r.sum) for r in pyramid.summarize_ranges(source, path, levels, even).collect()}
    b = {r.bin: (r["count"], r.sum) for r in loci.summarize_loci(source, even, 2).collect()}
    assert a == b
