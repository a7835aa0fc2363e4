"""Sessions in stretches of time."""

from tendril.plans import flows


def test_many_batches_tell_what_one_does(spark, monkeypatch):
    told = lambda: sorted(map(tuple, flows.session_store(spark, "/root/testdata/sf0.001").collect()))
    whole = told()
    monkeypatch.setattr(flows, "SESSIONS_A_BATCH", 150)
    assert told() == whole and len({r[3] for r in whole}) > 1
