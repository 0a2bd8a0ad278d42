"""Queries over stored tables: lookups, changes, jobs, counts, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import epoch
from threadlake.operators import activity as A
from threadlake.operators import jobs as J
from threadlake.operators import threads as T
from threadlake.operators.ordering import positions
from threadlake.operators.merge import insert_absent, latest, remap, replace_children, upsert, without
from threadlake.plans.base import DRAFTS, JOBS, LINKED, MESSAGES, START, THREADS, Tables, query
from threadlake.sources.shared import sized

NOW = 1706000000


@query("""SELECT o_orderkey AS id, coalesce(c_name, '') AS subject, CASE WHEN coalesce(c_name, '') = '' THEN coalesce(n_name, '') ELSE c_name || ' <' || coalesce(n_name, '') || '>' END AS sender,
 (epoch_us(o_orderdate) // 1000000) AS date_unix FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE (epoch_us(o_orderdate) // 1000000) > 800000000""")
def envelope_newer_than(t: Tables) -> DataFrame:
    messages = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), epoch(F.col("o_orderdate")).alias("date_unix"))
    people = t.customer.select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("place"), F.col("c_name").alias("name"))
    return A.envelopes(messages, people, t.nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("address")), 800000000)


@query("""SELECT c_custkey AS id, coalesce(nullif(e, ''), nullif(n, ''), c_custkey::VARCHAR) AS label FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey || '@x.org' ELSE '' END AS e,
 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS n, c_custkey % 2 = 0 AS has FROM customer) WHERE e <> '' OR has""")
def account_labels(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    email = F.when(key % 3 == 0, F.concat(F.lit("u"), key, F.lit("@x.org"))).otherwise("")
    name = F.when(key % 5 == 0, "").otherwise(F.col("c_name"))
    return t.customer.where((email != "") | (key % 2 == 0)).select(key.alias("id"), F.coalesce(F.nullif(email, F.lit("")), F.nullif(name, F.lit("")), key.cast("string")).alias("label"))


@query(f"SELECT pk AS chunk_id, date_unix FROM {MESSAGES} WHERE date_unix BETWEEN {START + 100 * 3600} AND {START + 400 * 3600} ORDER BY date_unix, pk LIMIT 200")
def chunks_in_date_range(t: Tables) -> DataFrame:
    return t.messages.where(F.col("date_unix").between(START + 100 * 3600, START + 400 * 3600)).select(F.col("pk").alias("chunk_id"), "date_unix").orderBy("date_unix", "chunk_id").limit(200)


@query(f"SELECT vec_id AS chunk_id, label, message_id, account, date_unix FROM embeddings JOIN {MESSAGES} ON vec_id = pk")
def chunks_with_meta(t: Tables) -> DataFrame:
    return t.embeddings.join(t.messages, F.col("vec_id") == F.col("pk")).select(F.col("vec_id").alias("chunk_id"), "label", "message_id", "account", "date_unix")


@query("SELECT item_id, (item_id * 37) % 1500 AS doc_id, lang FROM benchmark JOIN documents ON doc_id = (item_id * 37) % 1500")
def ordered_lookup(t: Tables) -> DataFrame:
    wanted = t.benchmark.select("item_id", (F.col("item_id") * 37 % 1500).alias("doc_id"))
    return sized(wanted, 24).join(t.documents.select("doc_id", "lang"), "doc_id").select("item_id", "doc_id", "lang")


@query(f"""WITH m AS (SELECT message_id, pk, subject, date_unix FROM {MESSAGES} WHERE pk % 10 < 7), n AS (SELECT message_id, pk + 1000000 AS pk, 'New ' || pk AS subject, date_unix + 1 AS date_unix FROM {MESSAGES} WHERE pk % 10 > 4)
 SELECT coalesce(m.message_id, n.message_id) AS message_id, coalesce(m.pk, n.pk) AS pk, coalesce(n.subject, m.subject) AS subject, coalesce(n.date_unix, m.date_unix) AS date_unix FROM m FULL JOIN n USING (message_id)""")
def upsert_messages(t: Tables) -> DataFrame:
    rows = t.messages.select("message_id", "pk", "subject", "date_unix")
    old = rows.where(F.col("pk") % 10 < 7)
    new = rows.where(F.col("pk") % 10 > 4).select("message_id", (F.col("pk") + 1000000).alias("pk"), F.concat(F.lit("New "), F.col("pk")).alias("subject"), (F.col("date_unix") + 1).alias("date_unix"))
    return upsert(old, new, "message_id", keep=["pk"])


@query("""SELECT l_orderkey AS parent, l_linenumber AS n, l_quantity AS v FROM lineitem WHERE l_orderkey % 4 <> 0
 UNION ALL SELECT o_orderkey, k, 0.5 FROM orders, (VALUES (1::INT), (2::INT)) x(k) WHERE o_orderkey % 4 = 0""")
def replace_chunks(t: Tables) -> DataFrame:
    old = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("v"))
    new = t.orders.where(F.col("o_orderkey") % 4 == 0).select(F.col("o_orderkey").alias("parent"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), F.lit(0.5).alias("v"))
    return replace_children(old, new, "parent")


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def kv_last_write(t: Tables) -> DataFrame:
    return latest(t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq")), ["key"], ["seq"])


@query(f"""WITH j AS (SELECT * FROM {JOBS} WHERE source_id % 3 <> 0) SELECT source_id, state, attempts FROM j UNION ALL
 SELECT source_id, 'pending', 0 FROM {JOBS} n WHERE source_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM j WHERE j.source_id = n.source_id)""")
def enqueue_if_absent(t: Tables) -> DataFrame:
    rows = t.jobs.select("source_id", "state", "attempts")
    new = rows.where("source_id % 2 = 0").select("source_id", F.lit("pending").alias("state"), F.lit(0).cast("long").alias("attempts"))
    return insert_absent(rows.where("source_id % 3 <> 0"), new, "source_id")


@query(f"SELECT pk, coalesce(CASE WHEN conv_id % 2 = 1 THEN 't' || (conv_id - 1) END, thread_id) AS thread_id FROM {THREADS}")
def remap_groups(t: Tables) -> DataFrame:
    mapping = t.threads.where("conv_id % 2 = 1").select(F.col("thread_id").alias("old"), F.concat(F.lit("t"), F.col("conv_id") - 1).alias("new")).distinct()
    return remap(t.threads.select("pk", "thread_id"), mapping, "thread_id")


@query(f"""WITH u AS (SELECT source_id, CASE WHEN source_id % 4 = 0 THEN NULL ELSE 'x' || source_id END AS message_id, 'failed' AS state FROM {JOBS} WHERE source_id % 2 = 0)
 SELECT j.source_id, coalesce(u.message_id, j.message_id) AS message_id, coalesce(u.state, j.state) AS state FROM {JOBS} j LEFT JOIN u USING (source_id)""")
def coalesce_update(t: Tables) -> DataFrame:
    rows = t.jobs.select("source_id", "message_id", "state")
    new = rows.where("source_id % 2 = 0").select("source_id", F.when(F.col("source_id") % 4 != 0, F.concat(F.lit("x"), F.col("source_id"))).alias("message_id"), F.lit("failed").alias("state"))
    return upsert(rows, new, "source_id", keep_when_null=["message_id"])


@query("SELECT count(DISTINCT l_orderkey)::BIGINT AS parents, count(*)::BIGINT AS children FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(t: Tables) -> DataFrame:
    left = without(t.lineitem, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    return left.agg(F.count_distinct("l_orderkey").alias("parents"), F.count("*").alias("children"))


@query(f"SELECT source_id, state FROM {JOBS} WHERE NOT (updated_at < {NOW - 86400 * 4} AND (state IN ('newsletter_skipped','auto_generated','drafted') OR (state = 'failed' AND attempts >= 5)))")
def prune_jobs(t: Tables) -> DataFrame:
    return J.pruned(t.jobs, NOW - 86400 * 4).select("source_id", "state")


@query(f"SELECT pk FROM {DRAFTS} WHERE generated_at >= 850000000")
def prune_drafts(t: Tables) -> DataFrame:
    return t.drafts.where("generated_at >= 850000000").select("pk")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 9)")
def prune_failures_semi(t: Tables) -> DataFrame:
    valid = t.customer.where("c_nationkey < 9").select(F.col("c_custkey").alias("user_id"))
    return A.within(t.events, valid, "user_id").select("event_id", "user_id")


@query(f"""SELECT (SELECT count(*) FROM {MESSAGES}) AS messages, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM {JOBS} WHERE state = 'failed') AS failures,
 (SELECT count(*) FROM {DRAFTS} WHERE status = 'ready') AS ready_drafts""")
def store_counts(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    rows = one(t.messages, "messages").unionByName(one(t.embeddings, "chunks")).unionByName(one(t.jobs.where("state = 'failed'"), "failures")).unionByName(one(t.drafts.where("status = 'ready'"), "ready_drafts"))
    return rows.groupBy().pivot("name", ["messages", "chunks", "failures", "ready_drafts"]).agg(F.first("n"))


@query(f"SELECT state, count(*) AS jobs, (count(*) FILTER (attempts > 0))::BIGINT AS retried FROM {JOBS} GROUP BY state")
def job_state_counts(t: Tables) -> DataFrame:
    return t.jobs.groupBy("state").agg(F.count("*").alias("jobs"), F.count_if(F.col("attempts") > 0).alias("retried"))


@query(f"SELECT coalesce(max(pk), 0)::BIGINT AS cursor FROM {DRAFTS} WHERE status = 'ready'")
def max_ready_pk(t: Tables) -> DataFrame:
    return t.drafts.where("status = 'ready'").agg(F.coalesce(F.max("pk"), F.lit(0)).cast("long").alias("cursor"))


@query("""SELECT (count(*) FILTER (NOT same AND event_type <> 'error' AND value >= 10))::BIGINT AS ingested, (count(*) FILTER (NOT same AND event_type <> 'error' AND value < 10))::BIGINT AS empty,
 (count(*) FILTER (same))::BIGINT AS skipped, (count(*) FILTER (NOT same AND event_type = 'error'))::BIGINT AS failed FROM (SELECT *, event_id % 4 = 0 AS same FROM events)""")
def ingest_summary(t: Tables) -> DataFrame:
    same, bad, empty = F.col("event_id") % 4 == 0, F.col("event_type") == "error", F.col("value") < 10
    return t.events.agg(F.count_if(~same & ~bad & ~empty).alias("ingested"), F.count_if(~same & ~bad & empty).alias("empty"), F.count_if(same).alias("skipped"), F.count_if(~same & bad).alias("failed"))


@query(f"SELECT greatest({NOW}, coalesce(max((epoch_us(ts) // 1000000)) FILTER (epoch(ts) > 0), 0))::BIGINT AS watermark FROM events")
def watermark_advance(t: Tables) -> DataFrame:
    seen = epoch(F.col("ts"))
    return t.events.agg(F.greatest(F.lit(NOW).cast("long"), F.coalesce(F.max(F.when(seen > 0, seen)), F.lit(0).cast("long"))).alias("watermark"))


@query(f"SELECT DISTINCT event_id AS source_id, (epoch_us(ts) // 1000000) AS date_unix FROM events WHERE (epoch_us(ts) // 1000000) > greatest(0, {NOW} - 300) AND event_type = 'click' AND event_id % 5 <> 0")
def poll_with_grace(t: Tables) -> DataFrame:
    found = t.events.where(epoch(F.col("ts")) > max(0, NOW - J.GRACE)).where("event_type = 'click'")
    known = t.events.where("event_id % 5 = 0").select("event_id")
    return found.join(known, "event_id", "left_anti").select(F.col("event_id").alias("source_id"), epoch(F.col("ts")).alias("date_unix")).distinct()


@query(f"SELECT source_id, attempts, updated_at FROM {JOBS} WHERE state = 'failed' AND attempts < 5 AND {NOW} - updated_at >= least(pow(2, attempts) * 60, 3600)")
def retry_eligible(t: Tables) -> DataFrame:
    return t.jobs.where(J.retry_due(NOW)).select("source_id", "attempts", "updated_at")


@query(f"""SELECT source_id, CASE WHEN {NOW} - updated_at > 600 AND state = 'classifying' THEN 'pending' WHEN {NOW} - updated_at > 600 AND state = 'drafting' THEN 'eligible' ELSE state END AS state,
 CASE WHEN {NOW} - updated_at > 600 AND state IN ('classifying', 'drafting') THEN {NOW} ELSE updated_at END AS updated_at FROM {JOBS}""")
def recover_stuck(t: Tables) -> DataFrame:
    return J.recovered(t.jobs, NOW).select("source_id", "state", "updated_at")


@query(f"""SELECT source_id, (state <> 'pending')::INT AS block, row_number() OVER (ORDER BY state <> 'pending', detected_at, source_id) AS position FROM {JOBS}
 WHERE state = 'pending' OR (state = 'failed' AND attempts < 5 AND {NOW} - updated_at >= least(pow(2, attempts) * 60, 3600))""")
def classify_queue(t: Tables) -> DataFrame:
    return positions(J.queue(t.jobs, NOW).select("source_id", "block", "detected_at"), ["block", "detected_at", "source_id"]).select("source_id", "block", "position")


@query(f"SELECT source_id, state FROM {JOBS} WHERE state IN ('eligible', 'drafting') ORDER BY detected_at, source_id LIMIT 100")
def jobs_in_states(t: Tables) -> DataFrame:
    return t.jobs.where(F.col("state").isin("eligible", "drafting")).orderBy("detected_at", "source_id").limit(100).select("source_id", "state")


@query(f"""SELECT source_id, state, event, CASE WHEN event = 'claim' AND state IN ('pending', 'failed') THEN 'classifying' WHEN event = 'claim' AND state = 'eligible' THEN 'drafting'
 WHEN state = 'classifying' AND event = 'personal' THEN 'eligible' WHEN state IN ('classifying', 'drafting') AND event = 'error' THEN 'failed' WHEN state = 'drafting' AND event = 'done' THEN 'drafted' ELSE state END AS next
 FROM (SELECT source_id, state, ['claim', 'personal', 'error', 'done'][source_id % 5 % 4 + 1] AS event FROM {JOBS})""")
def job_transition(t: Tables) -> DataFrame:
    events = F.array(*[F.lit(e) for e in ("claim", "personal", "error", "done")])
    rows = t.jobs.withColumn("event", F.element_at(events, (F.col("source_id") % 5 % 4 + 1).cast("int")))
    return rows.select("source_id", "state", "event", J.transition(F.col("state"), F.col("event")).alias("next"))


@query(f"SELECT thread_id, max(pk) AS pk, arg_max(status, pk) AS status FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY generated_at DESC, pk DESC) AS r FROM {DRAFTS}) WHERE r = 1 GROUP BY thread_id")
def latest_draft(t: Tables) -> DataFrame:
    return latest(t.drafts.select("thread_id", "pk", "status", "generated_at"), ["thread_id"], ["generated_at", "pk"]).select("thread_id", "pk", "status")


@query(f"SELECT pk, thread_id, generated_at FROM {DRAFTS} WHERE status = 'ready' ORDER BY generated_at DESC, pk DESC LIMIT 200")
def ready_drafts(t: Tables) -> DataFrame:
    return t.drafts.where("status = 'ready'").orderBy(F.desc("generated_at"), F.desc("pk")).limit(200).select("pk", "thread_id", "generated_at")


@query(f"SELECT pk, thread_id FROM {DRAFTS} WHERE status = 'ready' AND pk > 500 ORDER BY pk LIMIT 200")
def ready_since_cursor(t: Tables) -> DataFrame:
    return t.drafts.where("status = 'ready' AND pk > 500").orderBy("pk").limit(200).select("pk", "thread_id")


@query(f"SELECT (pk > 500) AS is_new, count(*) AS drafts, max(pk) AS cursor FROM {DRAFTS} WHERE status = 'ready' GROUP BY pk > 500")
def cursor_delta(t: Tables) -> DataFrame:
    return t.drafts.where("status = 'ready'").groupBy((F.col("pk") > 500).alias("is_new")).agg(F.count("*").alias("drafts"), F.max("pk").alias("cursor"))


@query(f"SELECT pk, thread_id FROM {DRAFTS} WHERE style_learned_at IS NULL AND status = 'sent' AND generated_at < 890000000 ORDER BY generated_at, pk LIMIT 5")
def style_candidates(t: Tables) -> DataFrame:
    return t.drafts.where("style_learned_at IS NULL AND status = 'sent' AND generated_at < 890000000").orderBy("generated_at", "pk").limit(5).select("pk", "thread_id")


@query(f"""SELECT scope, count(*) AS sample_count FROM (SELECT unnest(['global', 'domain:shop' || o_custkey % 3, 'address:c' || o_custkey || '@shop' || o_custkey % 3 || '.example.com']) AS scope FROM orders) GROUP BY scope""")
def style_sample_counts(t: Tables) -> DataFrame:
    return style_scope_rows(t).groupBy("scope").agg(F.count("*").alias("sample_count"))


@query("SELECT o_orderkey AS pk, unnest(['global', 'domain:example', 'address:c' || o_custkey || '@shop' || o_custkey % 3 || '.example.com']) AS scope FROM orders")
def style_scopes(t: Tables) -> DataFrame:
    from threadlake.functions.text import sender_address, sender_domain

    s = F.col("sender")
    scopes = F.array(F.lit("global"), F.concat(F.lit("domain:"), sender_domain(s)), F.concat(F.lit("address:"), sender_address(s)))
    return t.drafts.select("pk", F.explode(scopes).alias("scope"))


def style_scope_rows(t: Tables) -> DataFrame:
    host = F.regexp_extract("sender", "@(shop[0-9])", 1)
    return t.drafts.select(F.explode(F.array(F.lit("global"), F.concat(F.lit("domain:"), host), F.concat(F.lit("address:"), F.col("sender")))).alias("scope"))


@query("""SELECT user_id, min(e)::BIGINT AS start_unix, max(e)::BIGINT AS last_unix, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY e, event_id) AS s FROM
 (SELECT user_id, event_id, (epoch_us(ts) // 1000000) AS e, CASE WHEN (epoch_us(ts) // 1000000) - lag((epoch_us(ts) // 1000000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def debounce_sessions(t: Tables) -> DataFrame:
    return A.debounced(t.events.select("user_id", "event_id", "ts", epoch(F.col("ts")).alias("at")), "user_id", "event_id", "ts")


@query("SELECT user_id, (epoch_us(ts) // 1000000) // 3600 * 3600 AS window_start, arg_max(event_type, event_id) AS last_type, count(*) AS events FROM events GROUP BY ALL")
def throttle_window(t: Tables) -> DataFrame:
    return A.throttled(t.events.withColumn("at", epoch(F.col("ts"))), "user_id", "event_type", "event_id").withColumnRenamed("last", "last_type")


@query(f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts) // 1000000 DESC, event_id DESC) AS r FROM events WHERE event_type <> 'view' AND (epoch_us(ts) // 1000000) BETWEEN {NOW} - 43200 AND {NOW}) WHERE r <= 20000""")
def rolling_log_window(t: Tables) -> DataFrame:
    return A.recent(t.events.where("event_type <> 'view'").withColumn("at", epoch(F.col("ts"))), NOW, 43200, 20000, "event_id").select("event_id")


@query("SELECT n_regionkey AS grp, arg_max(n_name, n_nationkey) AS path, max(n_nationkey) AS version FROM nation GROUP BY n_regionkey")
def max_by_version(t: Tables) -> DataFrame:
    return A.highest(t.nation.select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("path"), F.col("n_nationkey").alias("version")), "grp", "version", "path")


@query("SELECT EXISTS (SELECT 1 FROM events WHERE event_type = 'error') AS has_errors, EXISTS (SELECT 1 FROM events WHERE event_type = 'nothing') AS has_nothing")
def exists_probe(t: Tables) -> DataFrame:
    both = A.exists(t.events, "has_errors", F.col("event_type") == "error").unionByName(A.exists(t.events, "has_nothing", F.col("event_type") == "nothing"))
    return both.groupBy().pivot("name", ["has_errors", "has_nothing"]).agg(F.first("found"))


PATHS = "concat('/mail/V10/', ['INBOX','Sent','Trash','Sent Messages'][o_custkey % 4 + 1], '.mbox/', o_orderkey % 3, '/', o_orderkey // 2, CASE WHEN o_orderkey % 2 = 0 THEN '.emlx' ELSE '.partial.emlx' END)"


def paths(t: Tables) -> DataFrame:
    box = F.element_at(F.array(*[F.lit(x) for x in ("INBOX", "Sent", "Trash", "Sent Messages")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    key = F.col("o_orderkey")
    return t.orders.select(F.concat(F.lit("/mail/V10/"), box, F.lit(".mbox/"), key % 3, F.lit("/"), F.floor(key / 2), F.when(key % 2 == 0, ".emlx").otherwise(".partial.emlx")).alias("path"), F.lit(1).alias("length"), key.alias("mtime"))


@query(f"""SELECT source_id, arg_min(path, (partial::INT, path)) AS path FROM (SELECT {PATHS} AS path, regexp_extract({PATHS}, '([0-9]+)(\\.partial)?\\.emlx$', 1)::BIGINT AS source_id, {PATHS} LIKE '%.partial.emlx' AS partial FROM orders) GROUP BY source_id""")
def file_index(t: Tables) -> DataFrame:
    from threadlake.sources.mail import file_index as index

    return index(paths(t)).select("source_id", "path")


@query(f"""SELECT source_id, arg_min(path, (partial::INT, path)) AS path FROM (SELECT {PATHS} AS path, regexp_extract({PATHS}, '([0-9]+)(\\.partial)?\\.emlx$', 1)::BIGINT AS source_id, {PATHS} LIKE '%.partial.emlx' AS partial FROM orders WHERE o_custkey % 4 <> 2) GROUP BY source_id""")
def scan_files_dedup(t: Tables) -> DataFrame:
    from threadlake.sources.mail import scan

    return scan(paths(t)).select("source_id", "path")


@query(f"SELECT DISTINCT nullif(regexp_extract({PATHS}, '(?:^|/)([^/]*)\\.mbox(?:/|$)', 1), '') AS mailbox FROM orders")
def mailbox_of_path(t: Tables) -> DataFrame:
    from threadlake.functions.text import mailbox_of

    return paths(t).select(mailbox_of(F.col("path")).alias("mailbox")).distinct()


@query(f"SELECT DISTINCT pk, referenced FROM (SELECT pk, unnest(list_concat([in_reply_to], refs)) AS referenced FROM {LINKED}) WHERE referenced IS NOT NULL")
def message_refs(t: Tables) -> DataFrame:
    return T.edges(t.linked)


@query(f"SELECT e.referenced, m.pk FROM (SELECT DISTINCT pk, unnest(list_concat([in_reply_to], refs)) AS referenced FROM {LINKED}) e JOIN {LINKED} m USING (pk) WHERE e.referenced IS NOT NULL")
def reverse_refs(t: Tables) -> DataFrame:
    return T.edges(t.linked).join(t.linked.select("pk"), "pk").select("referenced", "pk")


@query(f"""SELECT c.pk, arg_min(m.pk, c.at) AS parent FROM (SELECT pk, unnest(l) AS message_id, generate_subscripts(l, 1) AS at FROM (SELECT pk, list_concat([in_reply_to], list_reverse(refs)) AS l FROM {LINKED})) c
 JOIN {LINKED} m USING (message_id) GROUP BY c.pk""")
def nearest_parent(t: Tables) -> DataFrame:
    return T.nearest_parent(t.linked)


def thread_links(t: Tables) -> DataFrame:
    named = t.linked.select(F.col("pk").alias("b"), F.col("message_id").alias("referenced"))
    return T.edges(t.linked).join(named, "referenced").select(F.col("pk").alias("a"), "b")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT a.pk AS a, b.pk AS b FROM (SELECT pk, unnest(list_concat([in_reply_to], refs)) AS r FROM {LINKED}) a JOIN {LINKED} b ON a.r = b.message_id),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(pk, component) AS (SELECT pk, pk FROM {LINKED} UNION SELECT u.b, c.component FROM c JOIN u ON c.pk = u.a WHERE u.b > c.component)
 SELECT pk, min(component) AS component FROM c GROUP BY pk""")
def thread_components(t: Tables) -> DataFrame:
    return T.components(thread_links(t), t.linked.select("pk"))


@query(f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (ORDER BY pk) AS place, list_concat([in_reply_to], list_reverse(refs)) AS ahead FROM {LINKED}),
 a AS (SELECT place, unnest(ahead) AS name, unnest(range(len(ahead))) AS nth FROM n), l AS (SELECT a.place, a.nth, n.place AS other FROM a JOIN n ON n.message_id = a.name WHERE n.place <> a.place),
 k AS MATERIALIZED (SELECT place, message_id, (SELECT arg_min(other, nth) FROM l WHERE l.place = n.place AND other < n.place) AS near, coalesce((SELECT list(DISTINCT l.place) FROM l WHERE other = n.place AND l.place < n.place), []) AS waiting FROM n),
 s(step, names) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT step + 1, list_append(list_transform(names, lambda x: CASE WHEN list_contains(gone, x) THEN mine ELSE x END), mine)
  FROM (SELECT step, names, coalesce(names[near], message_id) AS mine, list_transform(waiting, lambda w: names[w]) AS gone FROM s JOIN k ON place = step + 1))
 SELECT message_id, names[place] AS thread_id FROM k, (SELECT names FROM s ORDER BY step DESC LIMIT 1)""")
def thread_replay(t: Tables) -> DataFrame:
    """Four blocks at least, so that threads go over their borders."""
    return T.replay(t.linked, block=max(1, t.linked.count() // 4))


@query(f"""SELECT thread_id, pk, row_number() OVER (PARTITION BY thread_id ORDER BY date_unix, pk) AS position FROM
 (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date_unix DESC, pk DESC) AS r FROM {THREADS}) WHERE r <= 3""")
def thread_window(t: Tables) -> DataFrame:
    return T.last_messages(t.threads, 3).select("thread_id", "pk", F.col("position").cast("long"))


@query(f"SELECT thread_id, pk FROM {THREADS} t WHERE turn <= (SELECT max(turn) FROM conversations c WHERE c.conv_id = t.conv_id AND turn % 3 = 2)")
def thread_prefix(t: Tables) -> DataFrame:
    return T.upto_target(t.threads.withColumn("is_target", F.col("turn") % 3 == 2)).select("thread_id", "pk")


@query(f"""SELECT lower(regexp_extract(sender, '<([^<>]*)>', 1)) AS address, arg_max(thread_id, (date_unix, pk)) AS thread_id FROM {THREADS} WHERE contains(sender, 'user@h') GROUP BY 1""")
def latest_thread_by_sender(t: Tables) -> DataFrame:
    """Every user's address, and as many that are only a part of one."""
    hosts = t.threads.select((F.col("conv_id") % 7).alias("h")).distinct()
    asked = hosts.select(F.explode(F.array(F.lit("user@h"), F.lit("ser@h"))).alias("name"), "h").select(F.concat("name", F.col("h"), F.lit(".example.net")).alias("address"))
    return T.latest_threads(t.threads, asked).select("address", "thread_id")


@query(f"""SELECT thread_id, bool_or(contains(lower(sender), 'assistant@h')) AS has_prior FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date_unix DESC, pk DESC) AS r FROM {THREADS}) WHERE r <= 20 GROUP BY thread_id""")
def has_prior_reply(t: Tables) -> DataFrame:
    return T.last_messages(t.threads, 20).groupBy("thread_id").agg(F.bool_or(F.contains(F.lower("sender"), F.lit("assistant@h"))).alias("has_prior"))


@query(f"""SELECT u.pk, min(a.pk) AS reply_pk, min(a.date_unix) - u.date_unix AS wait FROM {THREADS} u JOIN {THREADS} a ON a.thread_id = u.thread_id AND a.role = 'assistant' AND a.date_unix > u.date_unix WHERE u.role = 'user' GROUP BY u.pk, u.date_unix""")
def asof_first_reply(t: Tables) -> DataFrame:
    # one window over the thread instead of a join: the next reply after each row
    ahead = Window.partitionBy("thread_id").orderBy("date_unix", "pk").rowsBetween(1, Window.unboundedFollowing)
    reply = F.when(F.col("role") == "assistant", F.struct("date_unix", "pk"))
    rows = t.threads.select("pk", "role", "date_unix", F.first(reply, ignorenulls=True).over(ahead).alias("r"))
    return rows.where("role = 'user' AND r IS NOT NULL").select("pk", F.col("r.pk").alias("reply_pk"), (F.col("r.date_unix") - F.col("date_unix")).alias("wait"))


@query("""SELECT c_custkey AS id, scope, coalesce(a.v, d.v, g.v) AS value FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'address' WHEN c_nationkey % 2 = 0 THEN 'domain' ELSE 'global' END AS scope FROM customer) c
 LEFT JOIN (SELECT c_custkey AS k, 'a' || c_custkey AS v FROM customer WHERE c_custkey % 7 = 0) a ON a.k = c.c_custkey LEFT JOIN (SELECT n_nationkey AS k, 'd' || n_nationkey AS v FROM nation WHERE n_nationkey % 2 = 0) d ON d.k = c.c_nationkey
 CROSS JOIN (SELECT 'g' AS v) g""")
def scope_fallback(t: Tables) -> DataFrame:
    own = t.customer.where("c_custkey % 7 = 0").select("c_custkey", F.concat(F.lit("a"), F.col("c_custkey")).alias("a"))
    domain = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("d"), F.col("n_nationkey")).alias("d"))
    rows = t.customer.select("c_custkey", "c_nationkey").join(own, "c_custkey", "left").join(sized(domain, 60), "c_nationkey", "left")
    scope = F.when(F.col("a").isNotNull(), "address").when(F.col("d").isNotNull(), "domain").otherwise("global")
    return rows.select(F.col("c_custkey").alias("id"), scope.alias("scope"), F.coalesce("a", "d", F.lit("g")).alias("value"))


@query("""SELECT account, count(*) FILTER (pk % 6 = 0)::BIGINT AS picked FROM (SELECT lang AS account, doc_id AS pk FROM documents) GROUP BY account""")
def account_counts(t: Tables) -> DataFrame:
    return t.messages.groupBy("account").agg(F.count_if(F.col("pk") % 6 == 0).alias("picked"))
