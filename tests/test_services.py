"""Commits, providers, settings, learning and accounts."""

import pytest
from pyspark.sql import functions as F

from threadlake.functions.text import error_text, host_allowed, strip_forward_header
from threadlake.operators import learning, providers
from threadlake.operators.accounts import access_status
from threadlake.operators.merge import emptied
from threadlake.operators.settings import Settings, snapshot
from threadlake.sources.commit import Conflict, Store


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def test_commit_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.latest() == (-1, {})
    with store.transaction() as t:
        t.write("a", numbers(spark, 1))
        with store.transaction() as inner:
            assert inner is t
            inner.write("b", numbers(spark, 2))
        assert store.latest()[0] == -1  # the inner one is part of the outer
    assert store.latest()[0] == 0 and [r.n for r in store.read("b").collect()] == [2]
    with pytest.raises(ValueError), store.transaction() as t:
        t.write("a", numbers(spark, 9))
        raise ValueError
    assert [r.n for r in store.read("a").collect()] == [1] and len(list((tmp_path / "tables").iterdir())) == 2


def test_second_writer_of_a_number_fails(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    t, u = one.transaction(), two.transaction()
    with t:
        t.write("a", numbers(spark, 1))
    with pytest.raises(Conflict), u:
        u.write("a", numbers(spark, 2))
    assert [r.n for r in one.read("a").collect()] == [1]


def test_settings_snapshot(spark):
    rows = [("top_k", "5", 1), ("top_k", "9", 2), ("temperature", "warm", 1), ("unknown", "x", 1), ("account", "me@x", 1)]
    got = snapshot(spark.createDataFrame(rows, "k string, v string, updated_at long"))
    assert got == Settings(top_k=9, account="me@x") and snapshot(spark.createDataFrame([], "k string, v string, updated_at long")) == Settings()


def test_micro_batches_and_dead_letters(spark):
    def flaky(texts):
        assert len(texts) <= 4
        if any("bad" in t for t in texts):
            raise ValueError("no vector")
        return providers.letter_embedder(texts)

    rows = spark.createDataFrame([(i, "bad" if i == 5 else f"text {i}") for i in range(10)] + [(10, None), (11, "")], "chunk_id long, text string").coalesce(1)
    got = {r.id: r for r in providers.embedded(rows, flaky, batch=4).collect()}
    assert len(got) == 12 and {i for i, r in got.items() if r.error} == {4, 5, 6, 7} and got[5].vec is None
    assert abs(sum(x * x for x in got[0].vec) - 1) < 1e-9 and sum(got[10].vec) == 0


def test_lost_provider_ends_the_job(spark):
    def lost(texts):
        raise ConnectionError("refused")

    rows = spark.createDataFrame([(i, "x") for i in range(9)], "chunk_id long, text string").coalesce(1)
    with pytest.raises(Exception, match="3 calls in a row"):
        providers.embedded(rows, lost, batch=2).collect()
    few = providers.embedded(rows.limit(2), lost, batch=2).collect()
    assert [r.error for r in few] == ["refused"] * 2


def test_learning(spark):
    drafts = spark.createDataFrame([(1, "t1", "A <a@x.org>", 10), (2, "t1", "A <a@x.org>", 12), (3, "t2", "B <b@y.org>", 10)], "pk long, thread_id string, sender string, generated_at long")
    mails = spark.createDataFrame([("m0", "t1", "Me <ME@x>", 5, "old"), ("m1", "t1", "Me <me@x>", 20, "yes"), ("m2", "t1", "Me <me@x>", 30, "later"), ("m3", "t2", "B <b@y.org>", 40, "no")], "message_id string, thread_id string, sender string, date_unix long, text string")
    replies = learning.first_own_replies(drafts, mails, "me@X")
    assert sorted((r.pk, r.reply_id, r.reply) for r in replies.collect()) == [(1, "m1", "yes"), (2, "m1", "yes")]
    assert learning.first_own_replies(drafts, mails, "").count() == 0
    new, marked = learning.fresh(replies, spark.createDataFrame([], "thread_id string, reply_id string"))
    assert [r.pk for r in new.collect()] == [1] and [r.pk for r in marked.collect()] == [2]
    old = spark.createDataFrame([("global", "p", 3, 1)], "scope string, profile_text string, sample_count long, updated_at long")
    more = spark.createDataFrame([("global", " q ",), ("domain:x", "r"), ("address:a", " ")], "scope string, profile_text string")
    got = {r.scope: (r.profile_text, r.sample_count, r.updated_at) for r in learning.merged_profiles(old, more, 9, 4, 4).collect()}
    assert got == {"global": ("q", 4, 9), "domain:x": ("r", 1, 9)}
    assert learning.merged_profiles(old, more, 9, 4, 5).collect() == old.collect()
    aged = spark.createDataFrame([(i, i * 100_000, None if i % 2 else 1) for i in range(20)], "pk long, generated_at long, style_learned_at long")
    assert [r.pk for r in learning.awaiting(aged, 1_500_000).collect()] == [1, 3, 5, 7, 9]


def test_access_status(spark, tmp_path):
    assert access_status(spark, str(tmp_path)) == "ok" and access_status(spark, str(tmp_path / "none")) == "notFound"
    assert [t.count() for t in emptied(numbers(spark, 1), numbers(spark, 2))] == [0, 0]


def test_text_functions(spark):
    texts = ["no mark\r\nhere ", "a\nBegin forwarded message:\n\nFrom: x\nTo: y\n\n\nbody\n", "-----Original Message-----\nnot a header\nFrom: x", "x\nForwarded message", "Forwarded message\n\n\n", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in rows.orderBy("i").select(strip_forward_header(F.col("t")).alias("s")).collect()]
    assert got == ["no mark\r\nhere ", "a\n\nbody", "not a header\nFrom: x", "x", "", None]
    urls = ["https://API.x.org:8/p", "http://user@api.x.org", "http://evil.org/api.x.org", "no url", None, "http://[::1]:9/x"]
    got = [r.h for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(host_allowed(F.col("u"), ["api.x.org", "[::1]"]).alias("h")).collect()]
    assert got == [True, True, False, False, False, True]
    assert spark.range(1).select(error_text(F.lit("a\r\n\nb" + "c" * 400)).alias("e")).first().e == "a b" + "c" * 297


def test_latest_thread_checks_the_whole_address(spark):
    from threadlake.operators.threads import latest_thread

    rows = [(1, "t1", "Ann <ann@x.org>", 10), (2, "t2", "J <joann@x.org>", 20), (3, "t3", "J <joann@x.org>", 30), (4, "t4", "ANN@X.org", 15)]
    m = spark.createDataFrame(rows, "pk long, thread_id string, sender string, date_unix long")
    assert [r.thread_id for r in latest_thread(m, "Ann@x.org").collect()] == ["t4"]
    assert latest_thread(m, "ann@x.org", scan=2).count() == 0  # the limit comes before the exact check


def test_generator_settles_ambiguous_messages(spark):
    from threadlake.operators.classify import settled

    def chat(prompts):
        if "fail" in prompts[0]:
            raise ValueError("no")
        return ["Newsletter." if "sale" in prompts[0] else "hm"]

    rows = [(1, "ambiguous", "a", "s", "big sale"), (2, "ambiguous", "a", "s", "hello"), (3, "ambiguous", "a", "s", "fail"), (4, "personal", "a", "s", "sale"), (5, None, "a", "s", "sale")]
    df = spark.createDataFrame(rows, "pk long, verdict string, sender string, subject string, body_text string")
    assert {r.pk: r.verdict for r in settled(df, chat).collect()} == {1: "newsletter", 2: "ambiguous", 3: "ambiguous", 4: "personal", 5: None}


def test_stream_into_a_stored_table(spark, tmp_path):
    from threadlake.streaming import arrivals as A

    rows = [(0, "a", 1, "x"), (0, "b", 1, "x"), (1, "a", 3, "y"), (2, "a", 2, "late"), (2, "c", 5, "z")]
    df = spark.createDataFrame(rows, "part int, k string, seq long, v string")
    store = Store(spark, str(tmp_path / "store"))
    put = A.merging(store, "t", "k", "seq")
    A.replayed(df, "part", 3).writeStream.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    want = [("a", "y"), ("b", "x"), ("c", "z")]
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == want and store.latest()[0] == 2
    put(df.where("part = 2").drop("part").withColumn("v", F.lit("again")), 2)  # the batch comes again
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == want and store.latest()[0] == 2


def test_answers(spark):
    from threadlake.operators.evals import assertions

    rows = [
        (1, "The fee is 10 percent and due in May [1].", ["10 percent", "[1]"], ["John"], None, "en", None), (2, "Das steht nicht da, keine Angabe.", None, ["EUR"], [r"\\d{4}"], "de", True),
        (3, "Call 555-12345.", [], [], [r"[0-9]{3}-[0-9]{5}"], None, None), (4, "Der Preis ist hoch.", ["Preis"], None, None, "en", False), (5, "", ["x"], None, None, None, True),
    ]
    df = spark.createDataFrame(rows, "qid long, answer string, contains array<string>, not_contains array<string>, not_matches array<string>, lang string, refusal boolean")
    got = {r.qid: (r.has_all, r.has_none, r.no_match, r.right_language, r.right_refusal, r.passed) for r in assertions(df).collect()}
    assert got[1] == (True,) * 6 and got[2] == (True,) * 6 and got[3] == (True, True, False, True, True, False)
    assert got[4] == (True, True, True, False, True, False) and got[5] == (False, True, True, True, False, False)


def test_forward_header_splits_a_text_once(spark):
    """Each step is named several times; written out, the plan would split a text and look for the marker again for each."""
    rows = spark.createDataFrame([("a\nBegin forwarded message:\n\nFrom: x\nTo: y\n\nb",), (None,), ("c\n",), ("-----Original Message-----\nSent: z",)], "t string")
    out = rows.select(strip_forward_header(F.col("t")).alias("s"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and [r.s for r in out.collect()] == ["a\nb", None, "c\n", ""]
