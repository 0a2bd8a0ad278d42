"""Queries over streams and incremental ingestion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.operators import ingest as I
from threadlake.plans.text import BOILER, TRIM
from threadlake.plans.base import JOBS, MESSAGES, Tables, query
from threadlake.streaming import arrivals as A
from threadlake.streaming import jobs as K


BATCHES = 4
SLICED = f"(SELECT *, floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) * {BATCHES})::INT AS part FROM events)"


def arriving(t: Tables, late: bool = False, shuffled: bool = False, columns: Sequence[Column | str] = ("*",)) -> DataFrame:
    """Events in four micro-batches by time.

    With ``late`` one in fifty of the first quarter comes with the last, and one in
    seven comes twice; with ``shuffled`` one in five comes a batch later.
    """
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    low, high = t.events.agg(F.min(at), F.max(at)).first()
    rows = t.events.withColumn("part", F.floor((at - F.lit(low)) / F.lit(high - low + 1) * BATCHES).cast("int"))
    if late:
        rows = rows.withColumn("part", F.when((F.col("part") == 0) & (F.col("event_id") % 50 == 0), BATCHES - 1).otherwise(F.col("part")))
        rows = rows.unionByName(rows.where("event_id % 7 = 0"))
    if shuffled:
        rows = rows.withColumn("part", F.when(F.col("event_id") % 5 == 0, F.least(F.col("part") + 1, F.lit(BATCHES - 1))).otherwise(F.col("part")))
    return A.replayed(rows.withColumn("at", F.timestamp_micros(at)).select("part", *columns) if columns != ("*",) else rows.withColumn("at", F.timestamp_micros(at)), "part", BATCHES)


@query(f"SELECT DISTINCT event_id, user_id FROM {SLICED} WHERE NOT (part = 0 AND event_id % 50 = 0)")
def stream_first_arrivals(t: Tables) -> DataFrame:
    """Late rows are older than the watermark when they come, so they are dropped."""
    return A.drained(A.first_arrivals(arriving(t, late=True))).select("event_id", "user_id")


@query("SELECT epoch_us(ts) // 3600000000 * 3600 AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_window_counts(t: Tables) -> DataFrame:
    out = A.drained(A.window_counts(arriving(t)), "complete")
    return out.select((F.floor(F.unix_seconds("window.start") / 3600) * 3600).alias("window_start"), "event_type", "events")


STEP = " ".join(f"WHEN split_part(s, '|', 1) = '{a}' AND e = '{b}' THEN '{c}|' || split_part(s, '|', 2){'::INT + 1' if c == 'failed' else ''}" for (a, b), c in A.STEPS.items())


@query(f"""SELECT source_id, split_part(s, '|', 1) AS state, split_part(s, '|', 2)::BIGINT AS attempts FROM (SELECT source_id, list_reduce(list_prepend('pending|0', l), lambda s, e: CASE {STEP} ELSE s END) AS s FROM
 (SELECT user_id AS source_id, list(['claim','personal','error','done','newsletter'][event_id % 5 + 1] ORDER BY part, event_id) AS l FROM {SLICED} GROUP BY user_id))""")
def stream_job_states(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("claim", "personal", "error", "done", "newsletter")])
    rows = arriving(t).select(F.col("user_id").alias("source_id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("event"), F.col("event_id").alias("seq"))
    return A.drained(A.job_states(rows), "update", ["source_id"])


STUCK, GRACE = 600, 300
TIMED = f"(SELECT user_id, part, event_id, epoch_us(ts) // 1000 AS ms, ['claim','personal','error','done','newsletter'][event_id % 5 + 1] AS event FROM {SLICED})"
MARKS = f"(SELECT b, coalesce((SELECT max(ms) FROM {TIMED} WHERE part < b) - {GRACE * 1000}, 0) AS mark FROM (SELECT unnest(range({BATCHES + 1})) AS b))"


@query(f"""WITH r AS MATERIALIZED {TIMED}, u AS (SELECT DISTINCT user_id FROM r), marks AS MATERIALIZED {MARKS},
 t AS (SELECT user_id, part AS b, 0 AS kind, event_id AS nth, 'e' || event AS token FROM r UNION ALL SELECT user_id, part, 1, 0, 'd' || (max(ms) + {STUCK * 1000}) FROM r GROUP BY ALL UNION ALL SELECT user_id, b, 2, 0, 'w' || mark FROM u, marks),
 s AS (SELECT user_id AS source_id, list_reduce(list_prepend('pending|0|0|', list(token ORDER BY b, kind, nth)), lambda s, t: CASE
   WHEN t[1] = 'e' THEN (CASE {' '.join(f"WHEN split_part(s, '|', 1) = '{a}' AND t[2:] = '{e}' THEN '{c}|' || split_part(s, '|', 2){'::INT + 1' if c == 'failed' else ''} || '|' || split_part(s, '|', 3) || '|' || split_part(s, '|', 4) || ',{a}>{c}'" for (a, e), c in A.STEPS.items())} ELSE s END)
   WHEN t[1] = 'd' THEN split_part(s, '|', 1) || '|' || split_part(s, '|', 2) || '|' || CASE WHEN split_part(s, '|', 1) IN ('classifying', 'drafting') THEN t[2:] ELSE '0' END || '|' || split_part(s, '|', 4)
   WHEN split_part(s, '|', 3) <> '0' AND split_part(s, '|', 3)::BIGINT <= t[2:]::BIGINT THEN (CASE WHEN split_part(s, '|', 1) = 'classifying' THEN 'pending|' ELSE 'eligible|' END) || split_part(s, '|', 2) || '|0|' || split_part(s, '|', 4) || ',' || split_part(s, '|', 1) || '>' || CASE WHEN split_part(s, '|', 1) = 'classifying' THEN 'pending' ELSE 'eligible' END
   ELSE s END) AS s FROM t GROUP BY user_id)
 SELECT source_id, split_part(s, '|', 1) AS state, split_part(s, '|', 2)::BIGINT AS attempts, array_to_string(list_filter(string_split(split_part(s, '|', 4), ','), lambda x: x <> '')[-5:], ' ') AS log FROM s""")
def stream_job_timers(t: Tables) -> DataFrame:
    """Jobs that hang go back when the watermark has passed their time, and each keeps the last changes of its state."""
    kinds = F.array(*[F.lit(x) for x in ("claim", "personal", "error", "done", "newsletter")])
    rows = arriving(t, columns=[F.col("user_id").alias("source_id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("event"), F.col("event_id").alias("seq"), "at"])
    out = A.drained(K.job_machine(rows.withWatermark("at", f"{GRACE} seconds"), STUCK), "update", ["source_id"])
    return out.select("source_id", "state", "attempts", F.array_join("log", " ").alias("log"))


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS at, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, epoch_us(ts) AS us, event_id FROM events),
 s AS (SELECT *, sum((before IS NULL OR us - before > 3600000000)::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS burst FROM e)
 SELECT user_id, min(us) // 1000000 AS start_unix, max(us) // 1000000 AS last_unix, count(*) AS events FROM s GROUP BY user_id, burst HAVING max(us) + 3600000000 <= (SELECT max(epoch_us(ts)) - 864000000000 FROM events)""")
def stream_bursts(t: Tables) -> DataFrame:
    """Bursts that are over; a part of each batch comes with the next one, out of order, and none is lost."""
    out = A.drained(A.bursts(arriving(t, shuffled=True), "user_id", grace="10 days"))
    return out.select("user_id", F.unix_seconds("start").alias("start_unix"), F.unix_seconds("last").alias("last_unix"), "events")


FILES = "(SELECT event_id AS source_id, event_id % 3 || '-' || user_id AS fingerprint FROM events)"


@query(f"SELECT source_id, fingerprint FROM {FILES} f WHERE source_id % 4 <> 0")
def incremental_unseen(t: Tables) -> DataFrame:
    files = t.events.select(F.col("event_id").alias("source_id"), F.concat(F.col("event_id") % 3, F.lit("-"), F.col("user_id")).alias("fingerprint"))
    # a quarter is recorded unchanged, another with an older fingerprint
    state = files.where("source_id % 4 = 0").unionByName(files.where("source_id % 4 = 1").select("source_id", F.lit("old").alias("fingerprint")))
    return I.unseen(files, state)


@query("SELECT event_id AS source_id, CASE WHEN event_id % 2 = 1 THEN 'new' ELSE 'old' END AS error, CASE WHEN event_id % 2 = 1 THEN 9 ELSE 5 END::BIGINT AS failed_at FROM events WHERE (event_id % 4 = 0 AND event_id % 3 <> 0) OR (event_id % 2 = 1 AND event_id % 3 = 0)")
def dead_letters(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("source_id"), F.lit("p").alias("path"))
    old = rows.where("source_id % 4 = 0").select("*", F.lit("old").alias("error"), F.lit(5).cast("long").alias("failed_at"))
    tried = rows.where("source_id % 3 = 0").select("*", F.when(F.col("source_id") % 2 == 1, "new").alias("error"))
    return I.dead_letters(old, tried, 9).select("source_id", "error", "failed_at")


@query(f"SELECT max(date_unix) AS watermark FROM {MESSAGES}")
def ingest_watermark(t: Tables) -> DataFrame:
    rows = t.messages.select(F.when(F.col("pk") % 7 == 0, 0).otherwise(F.col("date_unix")).alias("date_unix")).unionByName(t.messages.agg(F.max("date_unix").alias("date_unix")))
    return rows.agg(I.watermark(5, rows).alias("watermark"))


@query("SELECT c_custkey AS id, c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 2 = 0) AS allowed FROM customer")
def stamp_guard(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    stored = F.when(key % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("m"), key % 3, F.lit("@"), (key % 2 + 1) * 384))
    return t.customer.select(key.alias("id"), I.stamp_allows(stored, F.lit("m1:latest"), F.lit(384), key % 5).alias("allowed"))


@query(f"SELECT source_id FROM {JOBS} WHERE detected_at > 1706000000 - 300 AND source_id % 2 = 1")
def arrivals_after_grace(t: Tables) -> DataFrame:
    rows = t.jobs.select("source_id", F.col("detected_at").alias("date_unix"))
    return I.after_grace(rows, rows.where("source_id % 2 = 0"), 1706000000).select("source_id")


LINES = r"regexp_replace({}, '\r\n|[\x0B\x0C\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
SHOWN = TRIM.format(f"array_to_string(list_filter(string_split(shown, chr(10) || chr(10)), lambda p: NOT regexp_matches(p, '{BOILER}')), chr(10) || chr(10))")
SQUEEZED = TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(body, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"""SELECT doc_id AS source_id, CASE WHEN bad THEN 'bad count' END AS error, CASE WHEN NOT bad THEN doc_id || '@x' END AS message_id, CASE WHEN NOT bad THEN CASE WHEN doc_id % 2 = 0 THEN 'Grüße' ELSE '=?utf-8?b?abcde?=' END END AS subject,
 CASE WHEN NOT bad THEN 'A <a@x.org>' END AS sender, CASE WHEN NOT bad THEN CASE WHEN doc_id % 3 = 0 THEN 1704099600 WHEN doc_id % 3 = 1 THEN 1704103200 ELSE 0 END END AS date_unix,
 CASE WHEN NOT bad AND whole LIKE '%Forwarded message%' THEN 'Ann <ann' || doc_id || '@x.org>' END AS original_sender,
 CASE WHEN NOT bad THEN CASE WHEN whole LIKE '%Forwarded message%' THEN {TRIM.format(LINES.format("regexp_replace(whole, '(?s)^-+ Forwarded message.*?Subject: s' || chr(10) || chr(10) || '?', '')"))} ELSE whole END END AS body_text,
 CASE WHEN NOT bad THEN CASE WHEN kind = 4 THEN 1 ELSE 0 END END::INT AS attachments FROM (
 SELECT doc_id, kind, bad, {SHOWN} AS whole FROM (
 SELECT doc_id, kind, doc_id % 50 = 0 AS bad, CASE WHEN kind = 3 THEN {SQUEEZED} ELSE {TRIM.format('body')} END AS shown FROM (
 SELECT doc_id, doc_id % 5 AS kind, CASE WHEN doc_id % 5 = 1 THEN t ELSE replace(t, chr(13) || chr(10), chr(10)) END AS body FROM (
 SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 5 <> 3 THEN '---------- Forwarded message ---------' || chr(10) || 'From: Ann <ann' || doc_id || '@x.org>' || chr(10) || 'Subject: s' || chr(10) || chr(10) ELSE '' END || coalesce(text, '') AS t FROM documents))))""")
def parse_emlx(t: Tables) -> DataFrame:
    """Whole documents as mail: plain, base64, alternative, HTML with style and script, and mixed with a PDF; one in fifty is broken."""
    from threadlake.sources.mail import parse_files

    n = F.col("doc_id")
    forward = F.when((n % 7 == 0) & (n % 5 != 3), F.concat(F.lit("---------- Forwarded message ---------\nFrom: Ann <ann"), n, F.lit("@x.org>\nSubject: s\n\n"))).otherwise("")
    text = F.concat(forward, F.coalesce("text", F.lit("")))
    markup = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda mark, kind, body: F.concat(F.lit(f"--{mark}\nContent-Type: {kind}\n\n"), body, F.lit("\n"))
    body = (
        F.when(n % 5 == 0, F.concat(F.lit("\n"), text))
        .when(n % 5 == 1, F.concat(F.lit("Content-Type: text/plain; charset=\"utf-8\"\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(text, "UTF-8"))))
        .when(n % 5 == 2, F.concat(F.lit("Content-Type: multipart/alternative; boundary=\"b;1\"\n\n"), part("b;1", "text/html", F.lit("<p>other</p>")), part("b;1", "text/plain", text), F.lit("--b;1--\n--b;1\n\nafter the end")))
        .when(n % 5 == 3, F.concat(F.lit("Content-Type: text/html\n\n<html><style>p{}</style><script>evil()</script><p>"), markup, F.lit("</p></html>")))
        .otherwise(F.concat(F.lit("Content-Type: multipart/mixed; boundary=m\n\n"), part("m", "text/plain", text), F.lit("--m\nContent-Type: application/octet-stream; name=\"a.PDF\"\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--m--\n")))
    )
    subject = F.when(n % 2 == 0, "=?utf-8?Q?Gr=C3=BC=C3=9Fe?=").otherwise("=?utf-8?b?abcde?=")
    date = F.when(n % 3 == 0, "Mon, 01 Jan 2024 10:00:00 +0100 (CET)").when(n % 3 == 1, "1 Jan 2024 10:00:00 +0000").otherwise("someday")
    mail = F.concat(F.lit("Message-ID: <"), n, F.lit("@x>\nFrom: A <a@x.org>\nSubject: "), subject, F.lit("\nDate: "), date, F.lit("\n"), body)
    data = F.encode(mail, "UTF-8")
    size = F.when(n % 50 == 0, F.lit("x")).otherwise(F.octet_length(data).cast("string"))
    files = t.documents.select(F.concat(F.lit("/m/INBOX.mbox/"), n, F.lit(".emlx")).alias("path"), F.concat(F.encode(F.concat(size, F.lit("\n")), "UTF-8"), data).alias("content"))
    return parse_files(files).select("source_id", "error", "message_id", "subject", "sender", "date_unix", "original_sender", "body_text", F.size("attachments").alias("attachments"))


LARGE = 20_000  # bytes of a file that are too many here


@query(f"""WITH f AS (SELECT doc_id, doc_id % 3 <> 0 AS first, doc_id % 6 = 1 AS changed, CASE WHEN strlen(coalesce(text, '')) > {LARGE} THEN 'file too large' WHEN doc_id % 10 = 0 THEN 'bad count' END AS error,
  coalesce(text, '') || CASE WHEN doc_id % 6 = 1 THEN chr(10) || chr(10) || 'changed' ELSE '' END AS t FROM documents),
 b AS (SELECT *, {SHOWN} AS body FROM (SELECT *, {TRIM.format("replace(t, chr(13) || chr(10), chr(10))")} AS shown FROM f))
 SELECT doc_id AS source_id, error, CASE WHEN NOT first OR changed OR error IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS at, CASE WHEN error IS NULL THEN md5(body) END AS body_md5, error IS NULL AND body <> '' AS has_vectors FROM b""")
def ingest_runs(t: Tables) -> DataFrame:
    """Documents as files on disk, read by a stream; then the rest comes, some are changed, and a second run takes those alone."""
    from threadlake.sources.commit import Store
    from threadlake.sources.mail import listing, mail_stream, put_files, small_files
    from threadlake.sources.shared import fresh_path

    folder, n = fresh_path(t.spark, "mail"), F.col("doc_id")
    head = F.concat(F.lit("Message-ID: <"), n, F.lit("@x>\nFrom: A <a@x.org>\nSubject: s\nDate: 1 Jan 2024 10:00:00 +0000\n\n"))

    def files(rows: DataFrame, more: str) -> DataFrame:
        # what is too large by its text is so by a multiple of the head
        data = F.encode(F.concat(head, F.coalesce("text", F.lit("")), F.lit(more)), "UTF-8")
        pad = F.when(F.octet_length(F.coalesce("text", F.lit(""))) > LARGE, F.lit(500)).otherwise(0)
        count = F.when(n % 10 == 0, "0").otherwise(F.octet_length(data).cast("string"))
        return rows.select(F.concat(F.lit(f"{folder}/INBOX.mbox/"), n, F.lit(".emlx")).alias("path"), F.concat(F.encode(F.concat(count, F.lit("\n")), "UTF-8"), data, F.encode(F.repeat(F.lit(" "), pad.cast("int")), "UTF-8")).alias("content"))

    store, most = Store(t.spark, fresh_path(t.spark, "ingested")), LARGE + 400
    put_files(files(t.documents.where("doc_id % 3 <> 0"), "")).count()
    run = mail_stream(t.spark, folder).writeStream.option("checkpointLocation", fresh_path(t.spark, "progress")).trigger(availableNow=True)
    with small_files(t.spark):
        run.foreachBatch(I.ingesting(store, lambda: 1, most=most)).start().awaitTermination()
    put_files(files(t.documents.where("doc_id % 3 = 0"), "").unionByName(files(t.documents.where("doc_id % 6 = 1"), "\n\nchanged"))).count()
    I.ingest(store, listing(t.spark, folder), 2, most=most)
    vectors = store.read("chunks").where("vec is not null").select("source_id").distinct().withColumn("has_vectors", F.lit(True))
    good = store.read("messages").join(vectors, "source_id", "left").select("source_id", F.lit(None).cast("string").alias("error"), F.col("stored_at").alias("at"), F.md5(F.encode("body_text", "UTF-8")).alias("body_md5"), F.coalesce("has_vectors", F.lit(False)).alias("has_vectors"))
    return good.unionByName(store.read("failures").select("source_id", "error", F.col("failed_at").alias("at"), F.lit(None).cast("string").alias("body_md5"), F.lit(False).alias("has_vectors")))
