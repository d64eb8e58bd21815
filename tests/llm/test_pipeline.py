from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_minhash import brute_components
from tests.llm.test_models import labelled
from weftscan.llm import minhash, pii, quality_classifier, quality_rules, registry


def test_pipeline_end_to_end(spark, tmp_path):
    docs = labelled(200, seed=4)
    good = [k for k, _, q in docs if q]
    rows = [(k, t, "en", "s", len(t)) for k, t, _ in docs]
    rows += [(1000 + k, rows[good[k]][1] + " end", "en", "s", 1) for k in range(10)] + [(2000, rows[good[11]][1] + " mail a@b.cd", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, _, q in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "minhash", "pii", "packing"]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = df.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert df.columns == columns
        kept.append({r.doc_id: r.text for r in df.collect()})
    junk = {k for k, _, q in docs if not q}
    assert not junk & kept[1].keys() and len(kept[1]) > 100
    assert kept[2].keys() == set(brute_components(list(kept[1].items())).values())
    assert kept[3].keys() == kept[2].keys() and not any("@" in t for t in kept[3].values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == kept[3].keys()


def test_registry_names_each_operator():
    names = sorted(int(k[2:].split("_")[0]) for k in registry.queries() if k.startswith("op"))
    assert names == list(range(1, 11))


def test_ties_and_clashing_names_of_stages(spark, tmp_path):
    """Columns named like the stages' own, rows that differ in other columns alone, empty tables."""
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, th string, n long, __id long, __score double, score double"
    text = labelled(3, seed=4)[0][1]
    rows = [(1, text, "en", lang, len(text), "r", 5, "t", 9, 7, 0.1, 0.2) for lang in ("b", None, "a")] + [(None, text, None, None, None, None, None, None, None, None, None, None)] * 2
    docs, none = spark.createDataFrame(rows, names), spark.createDataFrame([], names)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = minhash.stage(spark, docs, "").collect()
    assert sorted(tuple(r) for r in left if r.doc_id) == [rows[1]] and len(left) == 3
    scored = quality_classifier.stage(spark, docs, str(tmp_path))
    assert scored.columns == docs.columns and scored.count() in (0, 5)
    ruled = quality_rules.stage(spark, docs.withColumn("__s", F.lit(1)).withColumn("__bad", F.lit("x")), "")
    assert ruled.columns == [*docs.columns, "__s", "__bad"] and ruled.count() == 5
    for stage in (quality_rules.stage, minhash.stage, pii.stage, quality_classifier.stage):
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0
    clean = pii.stage(spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == 5
