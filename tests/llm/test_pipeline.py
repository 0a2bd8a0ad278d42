"""The pipeline against a plain version of its stages on a small table."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_effects(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mixture", "tokens"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], DATA)
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.join(docs, docs.columns, "left_anti").count() == 0
        seen.append(out.cache())
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & ids[1]) >= 0.9 * len(good)
    texts = {r.doc_id: r.text for r in docs.collect()}
    from tests.llm.test_python import brute_components  # the plain join

    want = {c for _, _, c in brute_components([(i, texts[i]) for i in sorted(ids[1])], 5, 80)}
    assert ids[2] == want
    assert not any(t in texts[i] for i in ids[3] for t in items)
    assert ids[3] >= {i for i in ids[2] if not any(w in texts[i] for t in items for w in [" ".join(t.split()[2:7])])}
    assert 0 < len(ids[4]) < len(ids[3]) and ids[5] == ids[4]


def test_stages_handle_hard_tables(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(30)) for _ in range(8)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (50, "", None, "s", 0), (51, None, "en", None, None), (0, texts[0], "en", "s", 9), (0, texts[0], "en", "s", 9), (None, texts[1], None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[2]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, str(tmp_path)).count() <= table.count(), name
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([*enumerate(texts), (None, None), (50, ""), (51, None)], key=str)
    shared = spark.createDataFrame([(7, texts[0], "en", "s", 1), (7, texts[1], "en", "s", 1), (8, texts[1], "en", "s", 1)], schema)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, shared, str(tmp_path)).collect()) == sorted([(7, texts[0]), (7, texts[1])])
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).where(F.col("doc_id") == 2).count() == 0


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    from tests.llm.test_python import brute_components

    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [new(120) for _ in range(12)]
    texts += [t + new(24) for t in texts[:4]] + [t[:99] for t in texts[4:8]] + [t + new(40) for t in texts[8:10]]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()}
    assert kept == {c for _, _, c in brute_components([r[:2] for r in rows], 5, 80)} == {*range(12), 20, 21}


def test_columns_with_clashing_names_come_back(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    base = spark.createDataFrame([(i, words(40), "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["quality_score", "score", "hits", "mix_source", "mix_tokens", "mix_probability", "row", "component_id", "id", "doc", "kept_0", "kept_5", "raw", "n", "digest"]
    docs = base.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name


def test_a_very_long_text_goes_through_every_stage(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item, long = words(30), words(150_000)
    texts = [long, long + " " + words(100), long[:500_000] + " " + item + " " + long[500_000:], words(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(corpus_pipeline.quality(spark, docs, str(tmp_path))) == [0, 1, 2, 3]
    assert ids(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))) == [0, 3]
    assert ids(corpus_pipeline.decontaminate(spark, docs, str(tmp_path))) == [0, 1, 3]
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == 4
