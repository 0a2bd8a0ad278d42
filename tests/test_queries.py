"""Every registered query without SQL runs; a few with SQL are compared (the driver compares all)."""

import duckdb
import pytest

from threadlake import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["keyword_search", "vector_search", "hybrid_date_scoped", "chunk_documents", "html_to_text", "decode_entities", "classify_messages", "upsert_messages", "thread_components", "stream_first_arrivals",
    "stream_job_states", "parse_emlx", "date_range", "match_selection", "recall_at_k", "retrieve_excluding", "drop_counts", "draft_with_context", "atomic_commit", "micro_batch_embed", "runtime_answers", "profile_merge", "context_block", "forwarded_text", "vector_index_search", "keyword_search_changed", "oldest_in_range",
    "stream_job_timers", "stream_bursts", "chunk_lateral", "date_forms", "auto_submitted", "html_cap", "ingest_runs", "rendered_answers", "classify_queue", "account_discovery", "latest_thread_by_sender", "thread_replay"])
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    found = duck.execute(plans.SQL[name])
    order = [[c[0] for c in found.description].index(c) for c in names]
    assert got == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_thread_replay_is_the_plain_one(spark):
    from threadlake.plans.base import Tables

    rows = sorted(Tables(spark, DATA).linked.collect(), key=lambda r: r.arrival)
    thread, namers = {}, {}
    for r in rows:
        ahead = [x for x in (r.in_reply_to, *reversed(r.references)) if x]
        mine = next((thread[x] for x in ahead if x in thread), r.message_id)
        thread[r.message_id] = mine
        gone = {thread[x] for x in namers.get(r.message_id, ())} - {mine}
        thread = {k: mine if v in gone else v for k, v in thread.items()}
        for x in dict.fromkeys(ahead):
            namers.setdefault(x, []).append(r.message_id)
    assert {r.message_id: r.thread_id for r in plans.QUERIES["thread_replay"](spark, DATA).collect()} == thread


def test_mail_files_hold_whole_texts(spark, monkeypatch):
    from threadlake.sources import mail

    seen = []
    parse = mail.parse_files
    monkeypatch.setattr(mail, "parse_files", lambda files: seen.append(parse(files)) or seen[-1])
    assert plans.QUERIES["parse_emlx"](spark, DATA).count() == 200
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.source_id: r.body_text for r in seen[0].where("error is null").collect()}
    assert len(got) > 150 and max(map(len, got.values())) > 10_000
    assert all(body == texts[i].replace("\r\n", "\n").strip() for i, body in got.items())


def test_rules_read_whole_texts(spark, tmp_path):
    long = "word " * 500
    rows = [(5, long + "\n\nplease unsubscribe here"), (6, long), (7, None), (8, long), (24, long + "\n\nyou received this")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.verdict for r in plans.QUERIES["classify_messages"](spark, str(tmp_path)).collect()}
    assert got == {5: "ambiguous", 6: "personal", 7: "personal", 8: "ambiguous", 24: "newsletter"}
    assert [r.verdict for r in plans.QUERIES["classifier_metrics"](spark, str(tmp_path)).collect()] == ["ambiguous"]


def test_prompts_hold_whole_bodies(spark):
    from threadlake.operators import prompt
    from threadlake.plans.base import Tables
    from threadlake.plans.search import top_chunks

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = top_chunks(Tables(spark, DATA)).cache()
    hits = rows.select("qid", "chunk_id", "rank", "text").collect()
    assert max(len(r.text) for r in hits) > 400 and all(r.text == texts[r.chunk_id] for r in hits)
    shown = {r.qid: r.context for r in plans.QUERIES["context_block"](spark, DATA).collect()}
    first = {r.qid: r for r in sorted(hits, key=lambda r: -r["rank"])}
    assert set(shown) == set(first) and all(texts[r.chunk_id] in shown[q] for q, r in first.items())
    costs = prompt.budget_trim(rows, 600).select("chunk_id", "rank", "running").where("rank = 1").collect()
    assert costs and all(r.running >= len(texts[r.chunk_id]) // 4 for r in costs)
    rows.unpersist()


def test_no_rows_are_left_out(spark, duck, tmp_path):
    rows = [(1, "a", 1), (2, "b" * 40_000, 40_000), (3, "c", None), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.too_long, r.too_large) for r in plans.QUERIES["size_guards"](spark, str(tmp_path)).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, False), 4: (None, None)}
    scopes = plans.QUERIES["style_scopes"](spark, DATA)
    assert scopes.count() == 3 * duck.execute("select count(*) from orders").fetchone()[0]
    refs = {(r.referenced, r.pk) for r in plans.QUERIES["reverse_refs"](spark, DATA).collect()}
    assert refs == {(r.referenced, r.pk) for r in plans.QUERIES["message_refs"](spark, DATA).collect()} and any(pk % 2 for _, pk in refs)
    ranges = {r.qid: r for r in plans.QUERIES["date_range"](spark, DATA).collect()}
    assert len(ranges) == 200
    shown = lambda x: tuple(duck.execute("select epoch(?::timestamp)::bigint", [x]).fetchone())[0]
    assert (ranges[25].lo, ranges[25].hi) == (shown("2024-02-01"), shown("2024-03-01") - 1)


def test_bursts_within_one_second_go_by_number(spark, duck, tmp_path):
    """A pause ends within a second whose rows have numbers against their order in time; some rows have no time."""
    duck.execute("""create table odd as select * from (values (7, '2024-01-01 10:00:00.100', 1), (9, '2024-01-01 12:00:05.200', 1), (8, '2024-01-01 12:00:05.700', 1), (10, '2024-01-01 12:00:06', 1),
     (11, NULL, 1), (12, NULL, 1), (13, '2024-01-01 09:00:00', NULL), (14, '2024-01-01 09:59:59.900', NULL), (15, '2024-01-01 11:00:00', NULL)) v(event_id, ts, user_id)""")
    duck.execute(f"copy (select event_id::BIGINT as event_id, ts::TIMESTAMP as ts, user_id::BIGINT as user_id from odd) to '{tmp_path}/events.parquet' (format parquet)")
    got = [tuple(r[c] for c in ("user_id", "start_unix", "last_unix", "events")) for r in plans.QUERIES["debounce_sessions"](spark, str(tmp_path)).collect()]
    want = duck.execute(plans.SQL["debounce_sessions"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 6
