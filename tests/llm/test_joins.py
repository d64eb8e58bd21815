import pytest

from weftscan.llm import minhash, pii, quality_rules, store

from .conftest import prose

SECRETS = [f"token = {k:x}{'0a' * 18}" for k in range(16, 28)]


@pytest.mark.parametrize("stage", [quality_rules.stage, minhash.stage, pii.stage])
def test_spark_broadcasts_no_side_by_its_own_estimate(spark, monkeypatch, stage):
    """An explode is sized as what it explodes, so of 0.6 GB of documents all band keys went to the driver."""
    plans, stored = {}, store.table

    def planned(df, name, **options):
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().sparkPlan().toString()
        return stored(df, name, **options)

    for module in (minhash, pii, quality_rules):
        monkeypatch.setattr(module, "table", planned)
    monkeypatch.setattr(store, "fits_broadcast", lambda *a, **k: False)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        texts = [prose(k) + " " + s for k, s in enumerate(SECRETS)] + [prose(k) + f" {SECRETS[k]} more" for k in range(6)]
        docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        plans["out"] = (out := stage(spark, docs, ""))._jdf.queryExecution().sparkPlan().toString()
        assert out.count() == (len(SECRETS) if stage is minhash.stage else len(texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert any("SortMergeJoin" in p for p in plans.values())
    assert [name for name, p in plans.items() if "Broadcast" in p] == []
