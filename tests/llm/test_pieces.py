import numpy as np
import pyarrow as pa
import pytest

from tendril.llm import pieces

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, lossless string"
ODD = ["", "a", " ", "  two  spaces  ", "\n\n x\ty\r\n", "tab\tand\x0bothers\x0c", "你好, 😀!", "é" * 300, "word " * 50, "x" * 3000, " lead", "trail ", "a\nb", "    four", "\x00\x1f ctrl"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(PATH)


def encode(v, texts, dropout, seed=1):
    v.forget()
    return [r.tolist() for r in v.encode(pa.array(texts), np.arange(len(texts), dtype=np.uint64), dropout, seed)]


def test_equals_the_library_without_dropout(vocabulary, spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert encode(vocabulary, texts, 0.0) == library.encode(texts)


def test_dropout_varies_and_decodes(vocabulary):
    texts = [*ODD, "a ▁ literal", "the same words here and the same words there " * 20]
    plain, one, two = encode(vocabulary, texts, 0.0), encode(vocabulary, texts, 0.3), encode(vocabulary, texts, 0.3, 2)
    assert one == encode(vocabulary, texts, 0.3) and one != two and one != plain
    assert len(one[-1]) > len(plain[-1])
    for ids in (plain, one, two):
        assert [vocabulary.decode(np.asarray(r, np.int32)) for r in ids] == texts
    assert all(p is not None and len(p) == 1 for p in vocabulary.merge("characters", 5, 1.0))


def test_rounds_equal_the_agenda(vocabulary, spark, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    together = encode(vocabulary, texts, 0.2)
    monkeypatch.setattr(pieces, "ALONE", 0)
    assert encode(vocabulary, texts, 0.2) == together


def test_query_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "i", "l") for i, t in enumerate(ODD)] + [(None, None, "i", "l"), (3, ODD[3], "i", "l")], SCHEMA)
    encoded = pieces.encode_pieces(docs, PATH)
    rows = encoded.collect()
    assert len(rows) == len(ODD) + 2 and all(r.lossless for r in rows)
    got = {r.doc_id: r.text for r in pieces.decode_pieces(encoded, PATH).collect()}
    assert got == {**dict(enumerate(ODD)), None: ""}
    assert pieces.encode_pieces(docs.limit(0), PATH).count() == 0


def test_documents_decode(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pieces.encode_pieces(docs, PATH).collect()
    assert len(rows) == docs.count() and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)


def test_every_occurrence_is_cut_by_itself(vocabulary):
    texts = ["start" + " characters" * 3000]
    ids = np.array(encode(vocabulary, texts, 0.1)[0], np.int32)
    cuts, cut = {}, []
    for i in ids.tolist():
        if vocabulary.bytes[i].startswith(b" ") and cut:
            cuts[tuple(cut)] = cuts.get(tuple(cut), 0) + 1
            cut = []
        cut.append(i)
    assert len(cuts) > 9 and vocabulary.decode(ids) == texts[0]
