from pyspark.sql import functions as F

from tendril.llm.langid import drop_foreign, identify, identify_documents, identify_pages

SCHEMA = "doc_id long, text string, lang string, source string, host string, id string"


def test_documents_keep_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify_documents(docs).withColumnRenamed("lang", "told").join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(r.kept for r in rows)
    assert sum(r.told == r.lang for r in rows) > 0.98 * len(rows)
    # Text alone tells nearly all; declared languages are learnt from, not needed.
    assert sum(r.text_lang == r.lang for r in rows) > 0.97 * len(rows)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = identify_pages(pages).join(pages, "page_id").collect()
    assert len(rows) == 250
    assert sum(f'lang="{r.lang}"' in r.html for r in rows) > 240


def test_evidence_decides_where_text_does_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.concat("lang", F.lit(".site.example")).alias("source"))
    short = spark.createDataFrame([(10_001, " en ", None, "fr.site.example"), (10_002, " en ", None, "de.site.example"), (10_003, " en ", "es", None)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang for r in identify_documents(docs.union(short)).filter("doc_id > 10000").collect()}
    assert got == {10_001: "fr", 10_002: "de", 10_003: "es"}


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", "h", "i"), (2, "", "en", "s", "h", "i"), (3, "12 34 5!", None, None, "h", "i"), (None, "the word of the day " * 9000, "en", "s", "h", "i"), (5, "the word of the day", "EN ", "", "h", "i"), (5, "the word of the day", "xx", "", "h", "i"), (6, "你好吗我们" * 30, "zz", "s", "h", "i")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.lang, r.kept) for r in identify_documents(docs).collect()), key=str)
    assert got == sorted([(1, "und", False), (2, "und", False), (3, "und", False), (None, "en", True), (5, "en", True), (5, "en", True), (6, "und", False)], key=str)
    kept = drop_foreign(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert identify(docs.limit(0)).count() == 0


def test_rows_are_dropped_one_by_one(spark):
    """A rejected row takes no other row of its id, or without one, along."""
    english = "The committee will publish the whole report of the meeting on the following day, and everybody is welcome to read it."
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(None, english, "en", "src0"), (None, "12 34", "en", "src0"), (-1, english, None, None), (-7, english, "en", None), (-7, "", "en", None), (-7, None, "en", None)]
    more = spark.createDataFrame([(*r, 0, "mine", "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, said string")
    every = docs.withColumn("digest", F.lit("d")).withColumn("said", F.lit("s")).unionByName(more)
    left = drop_foreign(every)
    assert left.columns == every.columns
    got = sorted(((r.doc_id, r.text, r.digest) for r in left.filter("doc_id IS NULL OR doc_id < 0").collect()), key=str)
    assert got == sorted([(None, english, "mine"), (-1, english, "mine"), (-7, english, "mine")], key=str)
