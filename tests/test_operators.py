import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import ingest as I
from threadlake.operators import jobs as J
from threadlake.operators import prompt as P
from threadlake.operators import search as S
from threadlake.operators import threads as T
from threadlake.operators.chunking import chunk, chunks_of
from threadlake.operators.datescope import unix_range
from threadlake.operators.merge import insert_absent, latest, upsert

NOW = 1779969600  # Thursday, 28 May 2026, 12:00 UTC


def day(y, m, d):
    import calendar

    return calendar.timegm((y, m, d, 0, 0, 0))


@pytest.mark.parametrize(("question", "first", "last"), [
    ("mail of 2026-03-05", (2026, 3, 5), (2026, 3, 5)), ("am 05.03.2026", (2026, 3, 5), (2026, 3, 5)), ("25/12/2025 party", (2025, 12, 25), (2025, 12, 25)),
    ("today", (2026, 5, 28), (2026, 5, 28)), ("was war gestern", (2026, 5, 27), (2026, 5, 27)), ("on monday", (2026, 5, 25), (2026, 5, 25)), ("thursday", (2026, 5, 21), (2026, 5, 21)),
    ("past two weeks", (2026, 5, 14), (2026, 5, 28)), ("past 2 weeks", (2026, 5, 14), (2026, 5, 28)), ("letzte 3 Monate", (2026, 2, 28), (2026, 5, 28)), ("march", (2026, 3, 1), (2026, 3, 31)), ("december", (2025, 12, 1), (2025, 12, 31)),
    ("first week of april", (2026, 4, 1), (2026, 4, 7)), ("last week of april", (2026, 4, 24), (2026, 4, 30)), ("in 2024", (2024, 1, 1), (2024, 12, 31)),
    ("since march", (2026, 3, 1), (2026, 5, 28)), ("june 3rd 2025", (2025, 6, 3), (2025, 6, 3)), ("between january and march 2025", (2025, 1, 1), (2025, 3, 31)), ("2026-02-31", (2026, 3, 3), (2026, 3, 3)),
])
def test_date_ranges(question, first, last):
    assert unix_range(question, NOW) == (day(*first), day(*last) + 86399), question


def test_date_ranges_open_or_absent():
    assert unix_range("before 2026-05-01", NOW) == (0, day(2026, 5, 1) + 86399)
    for q in ("hello", "5/6/2026", "2026-13-01 2026", None, ""):
        assert unix_range(q, NOW) is None, q


def test_chunks_cover_and_fit():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "end. ", "\n", "\n\n", "x" * rng.randrange(40)]) for _ in range(rng.randrange(400)))
        got = chunks_of(text, 200, 40)
        assert all(0 < len(c) <= 200 for c in got)
        assert "".join("".join(got).split())[:20] == "".join(text.split())[:20]
        at = 0
        body = text.strip()
        for c in got:
            found = body.find(c, max(0, at - 45))
            assert found >= 0 and not body[at:found].strip()
            at = max(at, found + len(c))
        assert not body[at:].strip()


def test_chunk_frame(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, "  "), (3, None), (4, "short")], "k long, text string")
    assert sorted((r.k, r.ordinal, len(r.text)) for r in chunk(df, "k", "text").collect()) == [(1, 0, 2048), (1, 1, 2048), (1, 2, 1416), (4, 0, 5)]


def test_fusion_order(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 5, 3)], "qid long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (1, 1, 3)], "qid long, chunk_id long, rank int")
    assert [r.chunk_id for r in S.fuse(a, b).orderBy("rank").collect()] == [3, 1, 2, 5]


def test_vector_ties_and_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0]), (6, [0.0, 0.0])], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(7, [5.0, 0.0])], "qid long, vec array<double>")
    assert [(r.chunk_id, r.score) for r in S.vector_search(q, v).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0), (6, 0.0), (4, -1.0)]
    assert S.vector_search(q.limit(0), v).count() == 0


def test_keyword_without_terms(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, None)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "?!"), (2, "Red, fox")], "qid long, question string")
    got = S.keyword_search(q, S.postings(docs), S.corpus_stats(docs)).orderBy("rank").collect()
    assert [(r.qid, r.chunk_id) for r in got] == [(2, 1), (2, 2)]


def test_rendered_citations(spark):
    cases = {
        ("A [2]. B [1, 2] [9].", (1, 2)): ("A¹. B²\u2009¹.", [2, 1], [9]), ("", (1,)): ("", [], []), ("[3]", (3,)): ("¹", [3], []), ("x [7] y", ()): ("x y", [], [7]),
        ("a[1][1,1 , 2]  [2]z [x] [12]", (1, 2, 12)): ("a¹¹\u2009² ²z [x]³", [1, 2, 12], []), (" ".join(f"[{n}]" for n in range(1, 13)), tuple(range(1, 13))): ("¹²³⁴⁵⁶⁷⁸⁹¹⁰¹¹¹²", list(range(1, 13)), []),
    }
    df = spark.createDataFrame([(i, a, list(k)) for i, (a, k) in enumerate(cases)] + [(99, None, [1])], "i int, answer string, known array<long>")
    got = {r.i: r.r for r in df.select("i", P.rendered(F.col("answer"), F.col("known")).alias("r")).collect()}
    assert [(got[i].text, list(got[i].cited), list(got[i].lost)) for i in range(len(cases))] == list(cases.values()) and got[99] is None


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, pk long")
    new = spark.createDataFrame([(2, None, 99), (3, "c", 30)], "k long, v string, pk long")
    assert sorted(map(tuple, upsert(old, new, "k", keep_when_null=["v"], keep=["pk"]).collect())) == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
    assert sorted(r.k for r in insert_absent(old, new, "k").collect()) == [1, 2, 3]
    assert latest(old.unionByName(new), ["k"], ["pk"]).where("k = 2").first().pk == 99


@pytest.mark.parametrize(("question", "first", "last"), [
    ("first week of march or april 2025", (2025, 3, 1), (2025, 3, 7)), ("last week of march and march 2025", (2025, 3, 25), (2025, 3, 31)),
    ("march 5 or 10.06.2025", (2025, 3, 5), (2025, 6, 10)), ("zweite Woche im Juni 2025", (2025, 6, 8), (2025, 6, 14)), ("march and may 2025", (2025, 3, 1), (2025, 5, 31))])
def test_ranges_of_several_months(question, first, last):
    assert unix_range(question, NOW) == (day(*first), day(*last) + 86399)


def test_chunks_do_not_divide_characters():
    rng = random.Random(4)
    units = ["a", "b", " ", ". ", "\n", "\r\n", "e\u0301", "👍🏽", "ü"]
    for _ in range(40):
        text = "".join(rng.choice(units) for _ in range(rng.randrange(100, 900))).strip()
        marks = text.replace("\r\n", "\0").replace("e\u0301", "\1").replace("👍🏽", "\2")
        want = [p.replace("\0", "\r\n").replace("\1", "e\u0301").replace("\2", "👍🏽").strip() for p in chunks_of(marks, 64, 16)]
        assert chunks_of(text, 64, 16) == [p for p in want if p]


def plain_threads(order):
    thread, namers = {}, {}
    for own, parent, refs in order:
        ahead = [x for x in (parent, *reversed(refs)) if x]
        mine = next((thread[x] for x in ahead if x in thread), own)
        thread[own] = mine
        gone = {thread[x] for x in namers.get(own, ())} - {mine}
        thread = {k: mine if v in gone else v for k, v in thread.items()}
        for x in dict.fromkeys(ahead):
            namers.setdefault(x, []).append(own)
    return thread


def replayed(spark, order, block):
    rows = [(i, own, parent, refs, i // 3) for i, (own, parent, refs) in enumerate(order)]  # arrivals tie
    df = spark.createDataFrame(rows, "pk long, message_id string, in_reply_to string, references array<string>, arrival long")
    out = T.replay(df.repartition(3), block).collect()
    got = {r.message_id: r.thread_id for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("block", [10**6, 45, 9])
def test_replay_is_the_plain_one(spark, block):
    """Many small mailboxes side by side, and one thread with half of all messages, some of which wait for a hub."""
    rng = random.Random(block)
    boxes = []
    for k in range(25):
        ids = [f"b{k}m{i}" for i in range(rng.randrange(1, 9))]
        boxes.append([(i, rng.choice([*ids, None, ""]), [rng.choice(ids) for _ in range(rng.randrange(3))]) for i in rng.sample(ids, len(ids))])
    many = [f"x{i}" for i in range(110)]
    big = [(m, rng.choice([many[max(0, i - rng.randrange(1, 20))], "x60", None, rng.choice(many)]), [rng.choice(many)] * rng.randrange(2)) for i, m in enumerate(many)]
    boxes.append(big)
    order = []
    while any(boxes):
        box = rng.choice([b for b in boxes if b for _ in range(1 + len(b) // 4)])
        order.append(box.pop(0))
    want = plain_threads(order)
    assert replayed(spark, order, block) == want and len(set(want.values())) > 20


def test_a_task_of_the_replay_has_its_share(spark, monkeypatch):
    """All messages wait for the last one: no block gets more than its own and one link for each."""
    seen = spark.sparkContext.accumulator(0)
    plain = T.replay_block

    def counted(batches):
        def through():
            for b in batches:
                seen.add(b.num_rows)
                yield b
        yield from plain(through())

    monkeypatch.setattr(T, "replay_block", counted)
    order = [(f"m{i}", "hub", []) for i in range(400)] + [("hub", "m7", [])]
    got = replayed(spark, order, 60)
    assert set(got.values()) == {"m7"} and len(got) == 401
    assert seen.value <= 401 + 2 * 60  # of 400 links to the hub those of its own block, and its nearest


def test_stuck_jobs_go_back_when_the_watermark_has_passed(spark):
    from threadlake.streaming import arrivals as A

    rows = [(0, 1, "claim", 1, "2024-01-01 00:00:00"), (0, 2, "claim", 2, "2024-01-01 00:00:10"), (0, 2, "personal", 3, "2024-01-01 00:00:11"), (1, 3, "claim", 4, "2024-01-01 02:00:00"), (2, 4, "claim", 5, "2024-01-01 02:00:01"), (3, 5, "claim", 6, "2024-01-01 02:00:02")]
    df = spark.createDataFrame(rows, "part int, source_id long, event string, seq long, at string").withColumn("at", F.col("at").cast("timestamp"))
    stream = A.replayed(df, "part", 4).withWatermark("at", "10 seconds")
    got = {r.source_id: r.state for r in A.drained(A.job_states(stream, 600), "update", ["source_id"]).collect()}
    assert got == {1: "pending", 2: "eligible", 3: "classifying", 4: "classifying", 5: "classifying"}


def test_replay_depends_on_order(spark):
    assert replayed(spark, [("c", "a", ["a", "b"]), ("a", None, []), ("b", None, [])], 1) == {"c": "b", "a": "b", "b": "b"}
    assert replayed(spark, [("a", None, []), ("b", None, []), ("c", "b", ["a", "b"])], 10) == {"a": "a", "b": "b", "c": "b"}


def test_replay_of_hard_rows(spark):
    """Repeated ids count when they first come, rows without an id are left out, a message may name itself."""
    rows = [(1, "a", None, None, 5), (2, None, "a", ["a"], 6), (3, "b", "a", [None, ""], 7), (4, "a", "z", [], 9), (5, "s", "s", ["s"], None), (6, "b", None, [], 8)]
    df = spark.createDataFrame(rows, "pk long, message_id string, in_reply_to string, references array<string>, arrival long")
    assert {tuple(r) for r in T.replay(df).collect()} == {("a", "a"), ("b", "a"), ("s", "s")}
    assert T.replay(df.limit(0)).count() == 0


def test_components(spark):
    nodes = spark.range(12).select(F.col("id").alias("pk"))
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (9, 8), (8, 7)], "a long, b long")
    got = {r.pk: r.component for r in T.components(links, nodes).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11}


@pytest.mark.parametrize("few", [0, 40])
def test_components_of_any_shape(spark, monkeypatch, few):
    """A chain in any order of its nodes, a star, a ring and a tree, in rounds alone and with what is left in one task."""
    monkeypatch.setattr(T, "FEW", few, raising=False)
    mixed = random.Random(few).sample(range(300), 300)
    links = list(zip(mixed, mixed[1:])) + [(4000, i) for i in range(4001, 4100)] + [(5000 + i, 5000 + (i + 1) % 60) for i in range(60)] + [(6000 + i, 6000 + i // 2) for i in range(100)] + [(7000, 7000), (8000, 7500)] * 2
    nodes = [*range(300), *range(4000, 4100), *range(5000, 5060), *range(6000, 6100), 7000, 7500, 8000, 9000]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.pk: r.component for r in T.components(df, spark.createDataFrame([(i,) for i in nodes], "pk long")).collect()}
    low = lambda i: next((k for k, end in ((0, 300), (4000, 4100), (5000, 5060), (6000, 6100)) if k <= i < end), i)
    assert got == {i: 7500 if i == 8000 else low(i) for i in nodes}


def test_rounds_of_the_replay(spark, monkeypatch):
    """What is left of links after some rounds is settled in one task; a thread goes through all blocks."""
    monkeypatch.setattr(T, "FEW", 100, raising=False)
    rng = random.Random(5)
    order = [(f"m{i}", f"m{max(0, i - rng.randrange(1, 40))}" if i % 9 else None, [f"m{min(299, i + 1)}"] if i % 5 == 0 else []) for i in range(300)]
    spark.sparkContext.setJobGroup("replay", "")
    got = replayed(spark, order, 75)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain_threads(order)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("replay")) < 150


def test_job_rules(spark):
    rows = spark.createDataFrame([(1, "failed", 2, 0), (2, "failed", 5, 0), (3, "drafting", 0, 0), (4, "drafted", 0, 0), (5, "pending", 0, 0)], "source_id long, state string, attempts long, updated_at long")
    assert [r.source_id for r in rows.where(J.retry_due(240)).collect()] == [1]
    assert [r.source_id for r in rows.where(J.retry_due(239)).collect()] == []
    assert {r.source_id: r.state for r in J.recovered(rows, 700).collect()}[3] == "eligible"
    assert sorted(r.source_id for r in J.pruned(rows, 10).collect()) == [1, 3, 5]


def test_ingest_is_idempotent(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "source_id long, fingerprint string")
    state = files.limit(0)
    once = I.recorded(state, I.unseen(files, state))
    assert I.unseen(files, once).count() == 0
    changed = spark.createDataFrame([(2, "c")], "source_id long, fingerprint string")
    assert [r.fingerprint for r in I.unseen(changed, once).collect()] == ["c"]


def test_rounds_of_components_are_stored_tables(spark):
    """The labels are read from the last round's table, and the tables of earlier rounds are gone."""
    from pathlib import Path

    from threadlake.sources.shared import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("table-*"))
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 200]], "pk long")
    found = T.components(links, nodes)
    left = set(shared.glob("table-*")) - before
    assert len(left) == 1 and found.inputFiles() and all(next(iter(left)).name in f for f in found.inputFiles())
    assert {r.pk: r.component for r in found.collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}
