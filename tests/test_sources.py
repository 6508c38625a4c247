"""Text and indexed sources: grammar, round trips, pruning, tiles."""

import gzip
import struct
import zipfile

import pytest
from pyspark.errors import PySparkException

from tracklake.plans import tile_fixture
from tracklake.sources import indexed, layouts, text

WIG = """track type=wiggle_0 name="a b" description="x"
# comment
browser position chr19

variableStep chrom=chr19 span=150
49304701 10.0
49304901\t12.5
fixedStep chrom="chr19" start=101 step=300 span=200
1000
NaN
-Infinity
variableStep chrom=chrX
5 1.01e+03
"""
ROWS = [("chr19", 49304700, 49304850, "10.0"), ("chr19", 49304900, 49305050, "12.5"), ("chr19", 100, 300, "1000.0"), ("chr19", 400, 600, "nan"), ("chr19", 700, 900, "-inf"), ("chrX", 4, 5, "1010.0")]


def shown(rows):
    return [(r.chrom, r.start, r.end, str(r.score)) for r in rows]


def test_wig_grammar_gz_and_zip(spark, tmp_path):
    (tmp_path / "a.wig").write_text(WIG)
    with gzip.open(tmp_path / "b.wig.gz", "wt") as f:
        f.write(WIG)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.wig", WIG)
    for name in ("a.wig", "b.wig.gz", "c.zip"):
        got = text.read_wig(spark, f"{tmp_path}/{name}").collect()
        assert sorted(shown(got)) == sorted(ROWS)
        assert len({r.section for r in got}) == 3


def test_zips_by_pattern_folder_and_list(spark, tmp_path):
    for name in "ab":
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x.bed", f"{name}\t1\t5\tr\n{name}\t2\t6")
    want = [(c, *r) for c in "ab" for r in ((1, 5, "r"), (2, 6, ""))]
    pattern = text.read_features(spark, f"{tmp_path}/{{a.zip,b.zip}}")
    assert sorted(map(tuple, pattern.collect())) == want
    (tmp_path / "c.bed").write_text("c\t3\t7\n")
    rows = text.lines(spark, str(tmp_path))
    assert sorted(r.value for r in rows.collect()) == ["a\t1\t5\tr", "a\t2\t6", "b\t1\t5\tr", "b\t2\t6", "c\t3\t7"]
    both = text.read_features(spark, [f"{tmp_path}/a.zip", f"{tmp_path}/c.bed"])
    assert sorted(map(tuple, both.collect())) == [*want[:2], ("c", 3, 7, "")]


def test_wig_in_many_splits(spark, tmp_path):
    lines = ["track type=wiggle_0"]
    want = []
    for s in range(6):
        lines.append(f"fixedStep chrom=c{s} start=1 step=10 span=5")
        lines += [str(k) for k in range(400)]
        want += [(f"c{s}", 10 * k, 10 * k + 5, str(float(k))) for k in range(400)]
    (tmp_path / "a.wig").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = text.read_wig(spark, f"{tmp_path}/a.wig")
        assert got.select("section").distinct().count() == 6
        assert sorted(shown(got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wig_windows_hold_blocks_and_not_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "BLOCK", 64)
    lines, want = ["track type=wiggle_0"], []
    for s in range(3):
        lines += [f"fixedStep chrom=c{s} start=1 step=10 span=5", *(str(k) for k in range(300)), f"variableStep chrom=v{s}", "7 1", "9 2"]
        want += [(f"c{s}", 10 * k, 10 * k + 5, str(float(k))) for k in range(300)] + [(f"v{s}", 6, 7, "1.0"), (f"v{s}", 8, 9, "2.0")]
    (tmp_path / "a.wig").write_text("\n".join(lines) + "\n")
    got = text.read_wig(spark, f"{tmp_path}/a.wig")
    assert sorted(shown(got.collect())) == sorted(want)
    specs = [x.split("specifiedwindowframe")[0] for x in got._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1:]]
    assert specs and all("_block" in x for x in specs)


@pytest.mark.parametrize("bad", ["track type=bedGraph\nvariableStep chrom=a\n1 2\n", "track type=wiggle_0\nfixedStep chrom=a\n1\n", "track type=wiggle_0\nvariableStep chrom=a\n1 2\nhello\n", "track type=wiggle_0\n1 2\nvariableStep chrom=a\n3 4\n", "variableStep chrom=a\nInf 2\n", "variableStep chrom=a\n1\n", "variableStep\n1 2\n", "variableStep chrom=a span=x\n1 2\n"])
def test_wig_faults(spark, tmp_path, bad):
    (tmp_path / "a.wig").write_text(bad)
    with pytest.raises(PySparkException):
        text.read_wig(spark, f"{tmp_path}/a.wig").collect()
    with pytest.raises(PySparkException):
        text.read_wig(spark, f"{tmp_path}/a.wig").count()
    assert text.read_wig(spark, f"{tmp_path}/a.wig", strict=False).count() <= 1


@pytest.mark.parametrize("bad", ["chr1 0 10 1.5\n", "track type=wiggle_0\nchr1 0 10 1.5\n", "chr1 0 1 1\ntrack type=bedGraph\nchr1 0 10 1.5\n", "track type=bedGraph\nchr1 x 10 1.5\n", "track type=bedGraph\nchr1 1 10\n"])
def test_bedgraph_faults(spark, tmp_path, bad):
    (tmp_path / "a.bg").write_text(bad)
    with pytest.raises(PySparkException):
        text.read_bedgraph(spark, f"{tmp_path}/a.bg").collect()


def test_feature_faults(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t1\t2\nchr1\tx\t4\nchr1\n")
    with pytest.raises(PySparkException):
        text.read_features(spark, f"{tmp_path}/a.bed").collect()
    assert [tuple(r) for r in text.read_features(spark, f"{tmp_path}/a.bed", strict=False).collect()] == [("chr1", 1, 2, ""), ("chr1", None, 4, ""), ("chr1", None, None, "")]


def test_bedgraph_features_and_sizes(spark, tmp_path):
    (tmp_path / "a.bg").write_text('track type=bedGraph name="x"\n# c\n\nchr1 0 10 1.5\nchr2\t5\t6\t-2\n')
    assert sorted(shown(text.read_bedgraph(spark, f"{tmp_path}/a.bg").collect())) == [("chr1", 0, 10, "1.5"), ("chr2", 5, 6, "-2.0")]
    (tmp_path / "a.bed").write_text("chr1\t1\t2\nchr1\t3\t4\tn\t5\t+\n")
    assert [tuple(r) for r in text.read_features(spark, f"{tmp_path}/a.bed").orderBy("start").collect()] == [("chr1", 1, 2, ""), ("chr1", 3, 4, "n\t5\t+")]
    (tmp_path / "s").write_text("chr1\t100\n")
    assert [tuple(r) for r in text.read_sizes(spark, f"{tmp_path}/s").collect()] == [("chr1", 100)]


@pytest.mark.parametrize("codec", ["none", "deflate", "snappy"])
def test_indexed_round_trips(spark, tmp_path, codec):
    signal = spark.createDataFrame([(f"c{k % 3}", k, k + 1 + k % 5, float(k % 11)) for k in range(9000)], "chrom string, start int, end int, score float").repartition(5)
    sizes = spark.createDataFrame([("c0", 9100), ("c2", 9100)], "chrom string, size int")
    made = indexed.write(signal, f"{tmp_path}/s", "bigwig", sizes, codec)
    assert made.agg({"items": "sum"}).first()[0] == 6000
    back = indexed.read(spark, f"{tmp_path}/s")
    want = signal.where("chrom <> 'c1'")
    assert back.count() == 6000 and want.exceptAll(back).count() == 0
    one = back.where("chrom = 'c2' AND start >= 4000 AND start < 4100")
    assert one.count() == want.where("chrom = 'c2' AND start >= 4000 AND start < 4100").count()
    assert back.where("chrom = 'zz'").count() == 0
    features = spark.createDataFrame([("c0", k, k + 3, f"n{k}\té" if k % 2 else "") for k in range(3000)], "chrom string, start int, end int, rest string")
    indexed.write(features, f"{tmp_path}/f", "bigbed", codec=codec)
    again = indexed.read(spark, f"{tmp_path}/f")
    assert again.count() == 3000 and features.exceptAll(again).count() == 0
    m = indexed.metadata(spark, f"{tmp_path}/f").first()
    assert m.kind == "bigbed" and m.compression == codec and m.total_count == 9000 and m.chromosomes == {0: "c0"}


def test_blocks_are_pruned_and_empty_files_read(spark, tmp_path):
    signal = spark.createDataFrame([("c", k, k + 1, 1.0) for k in range(50_000)], "chrom string, start int, end int, score float").coalesce(1)
    indexed.write(signal, f"{tmp_path}/s", "bigwig")
    counts = []
    for path in indexed.files_of(f"{tmp_path}/s"):
        with layouts.Input(path) as f:
            x = layouts.Indexed(f)
            counts.append((len(x.blocks()), len(x.blocks((0, 20_000), (0, 20_010)))))
    assert sum(a for a, _ in counts) >= 12 and sum(b for _, b in counts) <= 2
    indexed.write(signal.limit(0), f"{tmp_path}/e", "bigwig")
    assert indexed.read(spark, f"{tmp_path}/e").count() == 0


def test_big_endian_sections_and_probe(tmp_path):
    for order in "<>":
        head = lambda kind, n, step=0, span=0, o=order: struct.pack(o + "IIIIIBBH", 7, 100, 999, step, span, kind, 0, n)
        c, s, e, v = layouts.signal_items(head(3, 3, 10, 4) + struct.pack(order + "3f", 1, 2, 3), order)
        assert (c, s.tolist(), e.tolist(), v.tolist()) == (7, [100, 110, 120], [104, 114, 124], [1, 2, 3])
        _, s, e, v = layouts.signal_items(head(2, 2, 0, 4) + struct.pack(order + "ifif", 100, 1, 300, 2), order)
        assert (s.tolist(), e.tolist(), v.tolist()) == ([100, 300], [104, 304], [1, 2])
        (tmp_path / "x").write_bytes(struct.pack(order + "I", layouts.FEATURE_MAGIC) + bytes(60))
        assert layouts.kind_of(str(tmp_path / "x")) == "bigbed"
    (tmp_path / "x").write_bytes(b"nope")
    assert layouts.kind_of(str(tmp_path / "x")) is None


@pytest.mark.parametrize("compressed", [True, False])
def test_tiles(spark, tmp_path, compressed):
    nan = float("nan")
    tiles = [tile_fixture.bed_tile([(0, 5, [1.0, 2.0]), (7, 9, [nan, 4.0])], 2), None, tile_fixture.fixed_tile(100, 25, [[1.0, 2.0], [3.0, 4.0]]), tile_fixture.variable_tile([200, 230], 10.0, [[5.0, 6.0], [7.0, 8.0]])]
    data = tile_fixture.encode({"/c/z0/mean": (100, tiles), "/d/raw": (50, [])}, ["t1", "t2"], compressed, {"/": {"k": "v"}})
    (tmp_path / "a.tdf").write_bytes(data)
    rows = indexed.read(spark, f"{tmp_path}/a.tdf").where("dataset = '/c/z0/mean'")
    got = sorted((r.tile, r.track, r.start, r.end, str(r.value)) for r in rows.collect())
    assert got[:4] == [(0, 0, 0, 5, "1.0"), (0, 0, 7, 9, "nan"), (0, 1, 0, 5, "2.0"), (0, 1, 7, 9, "4.0")]
    assert (2, 1, 125, 150, "4.0") in got and (3, 0, 230, 240, "6.0") in got and len(got) == 12
    d = indexed.describe_tiles(f"{tmp_path}/a.tdf")
    assert d["tracks"] == ["t1", "t2"] and d["groups"] == {"/": {"k": "v"}} and d["datasets"]["/c/z0/mean"]["tiles"] == [0, 2, 3]
    with layouts.Input(f"{tmp_path}/a.tdf") as f:
        x = layouts.Tiled(f)
        assert x.dataset_of("c") == "/c/z0/mean" and x.dataset_of("d") == "/d/raw"
        with pytest.raises(KeyError):
            x.dataset("/none")
