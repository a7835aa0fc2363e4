import sys

import corpus_pipeline
from tendril.llm.packing import LENGTH, ChunkEncoder
from tendril.llm.shared import tokenizer_path

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from test_exact import brute as exact  # noqa: E402
from test_nearjoin import brute as near  # noqa: E402
from test_packing import check  # noqa: E402
from test_substring import brute as repeats  # noqa: E402


def test_stages_match_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    told = stages["language_id"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in told.collect()) == sorted(i for i, _ in rows)  # clean documents stay

    kept = {keep for _, keep, *_ in exact(rows)}
    rows = [(i, t) for i, t in rows if i in kept]
    alone = near(rows, 5)
    rows = [(i, t) for i, t in rows if alone[i][2]]
    texts = {i: t for i, (t, n, gone) in repeats(rows).items() if not gone or gone < n}

    result = corpus_pipeline.run(spark, sf_dir).collect()
    used, least = check(result, texts, LENGTH, ChunkEncoder(tokenizer_path("word_bpe_49k.json")).tokenizer)
    assert used <= least * 1.01 + 1


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_rows_without_or_with_shared_ids_pass_every_stage(spark, tmp_path):
    """Every text that no other row holds comes out, whatever its id."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = sorted((r.text for r in base.filter("lang = 'en' AND n_chars BETWEEN 300 AND 900").collect()), key=len)
    a, b, c, d = [t for k, t in enumerate(lines) if t not in lines[:k]][:4]
    rows = [(None, a), (None, "12 34"), (None, b), (7, c), (7, ""), (7, d), (-1, a + "\n"), (None, a), (-2, "%% 99")]
    odd = spark.createDataFrame([(i, t, "en", "src0", 0, "mine", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, uid int")
    docs = base.filter("doc_id > 100000").selectExpr("*", "'x' AS digest", "1 AS uid").unionByName(odd)
    stages = corpus_pipeline.STAGES
    for name, stage in stages[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "language_id":
            assert left == sorted([(None, a), (None, b), (7, c), (7, d), (-1, a + "\n"), (None, a)], key=str)
        else:  # of the equal texts the longest stays
            assert left == sorted([(None, b), (7, c), (7, d), (-1, a + "\n")], key=str), name
        assert {r.digest for r in docs.collect()} == {"mine"}
    tokenizer = ChunkEncoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    packed = stages[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    want = sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in [(-1, a + "\n"), (7, c), (7, d)])
    got = sorted((r.doc_id, r.length) for r in packed if r.doc_id is not None)
    assert got == want and sum(r.doc_id is None for r in packed) == 1
