"""Finds counted and masked in one reading."""

from pyspark.sql import functions as F

from tendril.functions import pii
from tendril.plans import registry

NAMES = [name for name, _ in pii.PATTERNS]


def test_counted_masks_as_mask_does(spark):
    texts = [None, "", "почта a@b.example и @user_1", f"{pii.MARK} a@b.example 10.0.0.1 {pii.MARK}", "г. Тихвин [ADDRESS] д. 3\nИНН 1234567890, +7 (999) 123-45-67", "1234 567890 11111111111111111111 111-222-333 44"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r for r in pii.counted(df, "text", NAMES, masked="masked").collect()}
    want = df.select("i", pii.mask(F.col("text")).alias("masked"), *[v.alias(k.lower()) for k, v in pii.counts(F.coalesce("text", F.lit("")), NAMES).items()]).collect()
    for r in want:
        assert got[r.i].masked == r.masked and all(got[r.i][n.lower()] == r[n.lower()] for n in NAMES)


def test_rows_are_dealt_out(spark):
    for name in ("pii_categories", "lookup_requests"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 8
    plan = registry.QUERIES["pii_categories"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2 * len(NAMES)
