"""Steps that are computed once, whatever reads them."""

from tendril.operators import store
from tendril.plans import flows, texts


def test_lines_are_numbered_once(spark, monkeypatch):
    seen, real = [], store.ResultStore.save
    monkeypatch.setattr(store.ResultStore, "save", lambda self, rows, *a: (seen.append(rows._jdf.queryExecution().optimizedPlan().toString()), real(self, rows, *a)))
    flows.rerun_results(spark, "/root/testdata/sf0.001").count()
    assert seen and "Window" not in seen[0]


def test_documents_are_dealt_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(texts.Jw, "anonymize", lambda docs, *a: seen.append(docs.rdd.getNumPartitions()))
    texts.json_walk(spark, "/root/testdata/sf0.01")
    assert seen[0] > 8


def test_close_pairs_of_blocks_are_found_once(spark, monkeypatch):
    calls, real = [], flows.written
    monkeypatch.setattr(flows, "written", lambda df: (calls.append(1), real(df))[1])
    assert flows.lookup_blocks(spark, "/root/testdata/sf0.001").columns and len(calls) == 1
