"""The feature codec: defaults, both directions, faults."""

import pytest
from pyspark.errors import PySparkException

from tracklake.functions import bed


def rows(spark, *rest):
    return spark.createDataFrame([("chr1", 1, 100, r) for r in rest], "chrom string, start int, end int, rest string")


def one(spark, rest, n=12, **options):
    return bed.unpack(rows(spark, rest), n, **options).first()


def test_all_twelve_fields(spark):
    r = one(spark, "\t".join(["gene7", "310", "-", "120", "480", "200,3,64", "3", "90,40,70,", "0,150,290", "left", "right"]))
    assert (r.name, r.score, r.strand, r.thick_start, r.thick_end, r.block_count, r.block_sizes, r.block_starts, r.extra_fields) == ("gene7", 310, "-", 120, 480, 3, [90, 40, 70], [0, 150, 290], ["left", "right"])
    assert r.item_rgb == (0xFF << 24 | 200 << 16 | 3 << 8 | 64) - (1 << 32)


def test_defaults_and_tails(spark):
    r = one(spark, "", 3)
    assert (r.name, r.score, r.strand, r.item_rgb, r.extra_fields) == (".", 0, ".", 0, None)
    assert one(spark, "a\tb", 3).extra_fields == ["a", "b"]
    assert one(spark, "a\t.\t\tx", 6).extra_fields == ["x"]
    assert one(spark, "\t7", 5).name == "."
    assert one(spark, "n\t1\t+\t", 6).extra_fields is None
    assert one(spark, "n\t1\tx\ty", 4, extra=False).extra_fields is None
    assert one(spark, "n 1 +", 6, delimiter=" ").strand == "+"
    assert one(spark, "n  1 +", 6, delimiter=" ", omit_empty=True).score == 1
    assert one(spark, "\t".join(["n", "0", "+", "1", "2", ".", "0", ".", "."])).block_sizes is None
    with pytest.raises(ValueError):
        bed.unpack(rows(spark, ""), 2)


@pytest.mark.parametrize("rest,n,field", [("n", 5, 4), ("n\tx", 5, 4), ("n\t1\t*", 6, 5), ("n\t1\t+\tx", 7, 6), ("n\t1\t+\t1\ty", 8, 7), ("n\t1\t+\t1\t2\t1,2", 9, 8), ("n\t1\t+\t1\t2\t0\tz", 10, 9), ("n\t1\t+\t1\t2\t0\t2\t4", 11, 10), ("n\t1\t+\t1\t2\t0\t2\t4,5\t1,q", 12, 11)])
def test_faults_name_their_field(spark, rest, n, field):
    r = bed.unpack(rows(spark, rest), n, strict=False).first()
    assert r.error.field == field and r.name is None
    with pytest.raises(PySparkException, match=f"field {field + 1}: "):
        bed.unpack(rows(spark, rest), n).collect()


def test_pack_is_the_inverse(spark):
    for rest, n in [("gene7\t310\t-\t120\t480\t200,3,64\t3\t90,40,70\t0,150,290\tleft\tright", 12), (".\t0\t.\t0\t0\t0\t0\t.\t.", 12), ("x\t1", 5), ("", 3), ("e1\te2", 3)]:
        assert bed.pack(bed.unpack(rows(spark, rest), n), n).first().rest == rest
    full = bed.unpack(rows(spark, "gene8\t40\t+\t7\t9\t0\t0\t.\t.\tleft\tright"))
    assert bed.pack(full, 4, 1).first().rest == "gene8\tleft" and bed.pack(full, 4, 0).first().rest == "gene8"
    wrong = full.withColumn("block_count", full.block_count + 3)
    with pytest.raises(PySparkException):
        bed.pack(wrong).collect()


def test_get_field(spark):
    d = bed.unpack(rows(spark, "gene9\t8\t+\tleft\tright"), 6)
    got = d.select(*(bed.field(i, 6) for i in range(10))).first()
    assert tuple(got) == ("chr1", "1", "100", "gene9", "8", "+", "left", "right", None, None)
    assert d.select(bed.field(7, 6, 1)).first()[0] is None
