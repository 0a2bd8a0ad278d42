"""The stored keyword index: changes, merges, and a pruned search that ranks as the exhaustive one."""

import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import index as I
from threadlake.operators.index import KeywordIndex
from threadlake.operators.search import containing, corpus_stats, keyword_search, postings

WORDS = [f"w{i}" for i in range(400)]


def texts(rng, ids):
    """Words with frequencies that fall; some texts empty or null, some terms in nearly all."""
    rows = []
    for i in ids:
        kind = rng.random()
        text = " ".join(["common"] + [WORDS[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(1, 60))])
        rows.append((i, None if kind < 0.02 else "" if kind < 0.04 else text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string")


def same(spark, index, live, questions, top_n=10):
    """The index answers as a fresh exhaustive search over the texts that are left."""
    docs = frame(spark, sorted(live.items()))
    key = lambda df: sorted((r.qid, r.rank, r.chunk_id, r.score) for r in df.collect())
    want = key(keyword_search(questions, postings(docs), corpus_stats(docs), top_n))
    for prune in (True, False):
        assert key(index.search(questions, top_n, prune)) == want
    return want


@pytest.fixture
def questions(spark):
    rng = random.Random(2)
    asked = [(q, " ".join(rng.choice([*WORDS, "common", "absent"]) for _ in range(rng.randrange(1, 12)))) for q in range(25)]
    return spark.createDataFrame([*asked, (90, "common common"), (91, "?!"), (92, None), (93, "absent")], "qid long, question string")


def test_changes_answer_as_a_fresh_index(spark, tmp_path, questions):
    rng = random.Random(4)
    index, live = KeywordIndex(spark, str(tmp_path / "index")), {}
    for start in (0, 300):
        rows = texts(rng, range(start, start + 300))
        live |= dict(rows)
        index.append(frame(spark, rows), merge=False)
    assert len(same(spark, index, live, questions)) > 100
    third = rng.sample(sorted(live), 200)
    changed = texts(rng, third[:100])  # a sixth is replaced, a sixth deleted
    live |= dict(changed)
    index.replace(frame(spark, changed), merge=False)
    for i in third[100:]:
        del live[i]
    index.delete(spark.createDataFrame([(i,) for i in [*third[100:], 10**6]], "chunk_id long"))
    same(spark, index, live, questions)
    again = texts(rng, third[80:120])  # some once more, some back again
    live |= dict(again)
    index.replace(frame(spark, again), merge=False)
    assert len(index.version.segments) == 4 and len(index.version.dead) == 3
    assert index.version.chunks == len(live)
    same(spark, index, live, questions)
    index.rewrite(index.version.segments[:2])  # those with most of the hidden chunks; what is hidden in others stays so
    assert len(index.version.segments) == 3 and index.version.chunks == len(live)
    same(spark, KeywordIndex(spark, str(tmp_path / "index")), live, questions)
    index.vacuum()
    index.rewrite(index.version.segments)
    assert len(index.version.segments) == 1 and index.version.dead == [] and index.version.chunks == len(live)
    same(spark, index, live, questions)
    index.delete(spark.range(10**4).withColumnRenamed("id", "chunk_id"))
    assert index.version.chunks == 0 and index.search(questions).count() == 0


def test_tiers_are_merged(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"))
    for k in range(9):
        index.append(frame(spark, texts(random.Random(k), range(k * 40, k * 40 + 40))))
    assert len(index.version.segments) < 4 and index.version.chunks == 360


def test_readers_keep_their_version_and_writers_exclude_each_other(spark, tmp_path, questions):
    path = str(tmp_path / "index")
    one = KeywordIndex(spark, path)
    one.append(frame(spark, texts(random.Random(1), range(60))))
    reader, other = KeywordIndex(spark, path), KeywordIndex(spark, path)
    before = sorted(map(tuple, reader.search(questions).collect()))
    one.delete(spark.range(30).withColumnRenamed("id", "chunk_id"))
    assert sorted(map(tuple, reader.search(questions).collect())) == before
    with pytest.raises(Exception, match="(?i)exist"):
        other.append(frame(spark, texts(random.Random(2), range(100, 110))), merge=False)
    assert KeywordIndex(spark, path).version.chunks == 30


def scanned(df):
    """Rows that the file scans of a plan gave, once it has run."""
    df.collect()
    plan, rows, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_only_asked_lists_are_read(spark, tmp_path, monkeypatch):
    """Folders and row groups of other terms stay closed: rows read go with the asked lists."""
    monkeypatch.setattr(I, "ROWS", 2_000)  # several folders
    rng = random.Random(6)
    rows = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(40))) for i in range(1500)]
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.append(frame(spark, rows))
    assert index.version.segments[0].folders >= 16
    keys = spark.createDataFrame([("t5",), ("t77",)], "term string")
    with I.many_literals(spark):
        lists = index.lists(keys)
        plan = lists._jdf.queryExecution().toString()
        blocks = spark.read.parquet(f"{index.path}/lists").count()
        assert scanned(lists) < blocks / 4
    assert "folder" in plan.split("PartitionFilters:")[1].split("]")[0] and "In(term, [t5,t77])" in plan.replace("Or(EqualTo(term,t5),EqualTo(term,t77))", "In(term, [t5,t77])")
    df = {r.term: r.df for r in index.bounds(keys).collect()}
    assert df == {t: sum(t in x.split() for _, x in rows) for t in ("t5", "t77")}


def test_blocks_of_long_lists(spark, tmp_path, questions):
    """Lists of many blocks, which bounds leave closed, and scores that tie."""
    rng = random.Random(8)
    rows = [(i, "common " * rng.randrange(1, 9) + ("rare " if i % 97 == 0 else "") + " ".join(f"f{rng.randrange(9)}" for _ in range(rng.randrange(1, 30)))) for i in range(3000)]
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.append(frame(spark, rows))
    asked = spark.createDataFrame([(1, "common rare f1"), (2, "common"), (3, "f1 f2 f3"), (4, "rare"), (5, "common f7 nothing")], "qid long, question string")
    for top_n in (1, 5, 40):
        same(spark, index, dict(rows), asked, top_n)


def test_an_empty_index(spark, tmp_path, questions):
    index = KeywordIndex(spark, str(tmp_path / "index"))
    assert index.search(questions).count() == 0 and index.version.number == 0
    index.append(frame(spark, []))
    index.delete(spark.range(3).withColumnRenamed("id", "chunk_id"))
    assert index.version.number == 0
    index.append(frame(spark, [(1, None), (2, "")]))
    assert index.version.chunks == 2 and index.search(questions).count() == 0
    index.append(frame(spark, [(3, "w1 w1"), (4, "w2")]), merge=False)
    same(spark, index, {1: None, 2: "", 3: "w1 w1", 4: "w2"}, questions)


def shuffled(spark, run):
    """Rows that the stages of ``run`` wrote for others to read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        all_ = store.stageList(None, False, False, quantiles, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (all_.apply(i) for i in range(all_.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_postings_are_not_shuffled_one_by_one(spark, tmp_path, monkeypatch):
    """Neither when a segment is written nor when many questions ask for most of it."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(120))) for i in range(3000)]
    rows += [(i, text) for i, text in enumerate(["t1 t2", "t1 t2", None, "", "none of them", "T3 t3 t4"], 3000)]
    docs = frame(spark, rows).repartition(4).persist()
    docs.count()
    postings = sum(len(set((text or "").split())) for _, text in rows)
    index = KeywordIndex(spark, str(tmp_path / "index"))
    assert shuffled(spark, lambda: index.append(docs)) < postings / 4
    asked = spark.createDataFrame([(q, " ".join(f"t{rng.randrange(70)}" for _ in range(9))) for q in range(30)], "qid long, question string")
    changed = frame(spark, texts(rng, range(0, 300)))
    monkeypatch.setattr(I, "SCANNED", 1_000)
    monkeypatch.setattr(I, "CELLS", 900)  # several cuts of a batch
    assert shuffled(spark, lambda: index.search(asked, 5).collect()) < postings / 4
    live = dict(rows)
    same(spark, index, live, asked)
    index.replace(changed, merge=False)
    index.delete(spark.range(300, 600).withColumnRenamed("id", "chunk_id"))
    live = {i: t for i, t in (live | {r.chunk_id: r.text for r in changed.collect()}).items() if not 300 <= i < 600}
    for top_n in (1, 40, 4000):
        same(spark, index, live, asked, top_n)


def test_texts_stay_where_they_are_while_passages_are_sought(spark, tmp_path):
    rng = random.Random(14)
    rows = [(i, " ".join(f"t{rng.randrange(500)}" for _ in range(20)) + (" one rare passage here" if i % 500 == 7 else "")) for i in range(3000)]
    docs = frame(spark, rows).repartition(4).persist()
    docs.count()
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.append(docs)
    asked = spark.createDataFrame([(1, "one rare passage here"), (2, "not in any of them")], "qid long, passage string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = []
    try:
        moved = shuffled(spark, lambda: found.extend(containing(asked, docs, index).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.qid, r.chunk_id) for r in found) == [(1, i) for i in range(7, 3000, 500)]
    assert moved < len(rows) / 2
