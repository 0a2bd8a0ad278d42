"""Queries over accounts, providers, learning, commits, decoders and the text functions of mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import decoders as D
from threadlake.functions import text as X
from threadlake.operators import accounts as A
from threadlake.operators import learning as L
from threadlake.operators import merge as M
from threadlake.operators import prompt as P
from threadlake.operators import providers as V
from threadlake.operators.ordering import positions
from threadlake.plans.base import DRAFTS, MESSAGES, THREADS, Tables, query
from threadlake.plans.search import DAY, TOP, TRIMMED, WITH, fused, top_chunks
from threadlake.plans.streams import LINES
from threadlake.plans.text import TRIM
from threadlake.sources.commit import Store
from threadlake.sources.shared import fresh_path, stored


@query("""WITH a AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) || c_custkey || '@x.org' END AS email,
 CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, c_custkey % 2 = 0 AS has FROM customer)
 SELECT id, coalesce(nullif(email, ''), nullif(name, ''), id) AS label, CASE WHEN email = '' THEN id ELSE email END AS storage_key, row_number() OVER (ORDER BY lower(coalesce(nullif(email, ''), nullif(name, ''), id)), id) AS position FROM a WHERE email <> '' OR has""")
def account_discovery(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    index = t.customer.limit(1).select(F.lit("MailData").alias("id"), F.lit(True).alias("has_messages"))
    folders = t.customer.select(key.cast("string").alias("id"), (key % 2 == 0).alias("has_messages")).unionByName(index)
    user = F.when(key % 3 == 0, "no address").otherwise(F.concat(F.lower("c_mktsegment"), key, F.lit("@x.org")))
    known = t.customer.where("c_custkey % 4 <> 0").select(key.cast("string").alias("id"), F.when(key % 5 != 0, F.col("c_name")).alias("name"), user.alias("username"))
    return positions(A.discover(folders, known).select("id", "label", "storage_key"), [F.lower("label"), "id"])


@query(f"SELECT pk, status FROM {DRAFTS} d WHERE NOT (status = 'ready' AND thread_id IN (SELECT 't' || c_custkey FROM customer WHERE c_nationkey < 9))")
def delete_by_status(t: Tables) -> DataFrame:
    threads = t.customer.where("c_nationkey < 9").select(F.concat(F.lit("t"), F.col("c_custkey")).alias("thread_id"))
    return M.without(t.drafts, threads, ["thread_id"], "ready").select("pk", "status")


@query("SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'")
def delete_cascade_rows(t: Tables) -> DataFrame:
    left = M.without(t.orders, t.orders.where("o_orderstatus = 'F'"), ["o_orderkey"])
    return M.cascaded(t.lineitem, left, "l_orderkey", "o_orderkey").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))


@query("SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, least(length(text), 1000) + 1), lambda n: strlen(substr(text, 1, n)) <= 1000))) AS text FROM documents")
def truncate_utf8(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncated_utf8(F.col("text"), 1000).alias("text"))


@query("SELECT doc_id, 'message://%3C' || list_reduce(list_prepend(url_encode('a b/ü' || doc_id || '+x''(1)@h' || lang), ['+', '@', '!', '$', '&', '''', '(', ')', '*', ',', ';', '=']), lambda s, c: replace(s, url_encode(c), c)) || '%3E' AS url FROM documents")
def message_links(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.message_url(F.concat(F.lit("a b/ü"), F.col("doc_id"), F.lit("+x'(1)@h"), F.col("lang"))).alias("url"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN text ELSE {TRIM.format(LINES.format('''text'''))} END AS text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Hi' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents)")
def forwarded_text(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    block = F.when(n % 3 == 0, "Hi\nBegin forwarded message:\n \nFrom: Ann <ann@x.org>\nSubject: s\nDate: today\n\n").when(n % 3 == 1, "-----Original Message-----\nSent: today\nTO: b@y\n\n").otherwise("")
    return t.documents.select("doc_id", X.strip_forward_header(F.concat(block, F.coalesce("text", F.lit("")))).alias("text"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[\r\n]+', ' ', 'g')), 1, 300) AS error FROM documents")
def error_bodies(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.error_text(F.col("text")).alias("error"))


@query("SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) IN (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) FROM pages WHERE page_id % 5 = 0 ORDER BY page_id LIMIT 20), false) AS allowed FROM pages")
def host_policy(t: Tables) -> DataFrame:
    hosts = [r.h for r in t.pages.where("page_id % 5 = 0").orderBy("page_id").limit(20).select(F.regexp_extract("url", "://([^/?#:]*)", 1).alias("h")).collect()]  # an allow list
    return t.pages.select("page_id", X.host_allowed(F.col("url"), hosts).alias("allowed"))


BODIES = "(SELECT event_id, '{\"models\":[{\"name\":\"' || event_type || '\",\"size\":' || user_id || ',\"details\":{\"embedding_length\":' || event_id % 1024 || '}},{\"size\":3}],\"model_info\":{\"x.other\":1,\"bert.embedding_length\":' || event_id % 768 || '}}' AS body, CASE event_id % 3 WHEN 0 THEN '{\"status\":\"pulling\",\"completed\":' || event_id || '}' WHEN 1 THEN ' ' ELSE '{\"error\":\"no ' || event_type || '\"}' END AS line FROM events)"


@query(f"""SELECT event_id, json_extract_string(body, '$.models[0].name') AS name, json_extract(body, '$.models[0].size')::BIGINT AS size, json_extract(body, '$.models[0].details.embedding_length')::INT AS length, len(list_filter(json_extract(body, '$.models[*]'), lambda m: json_exists(m, '$.name')))::INT AS models,
 json_extract(body, '$.model_info."bert.embedding_length"')::INT AS shown, json_extract_string(nullif(trim(line), ''), '$.status') AS status, json_extract(nullif(trim(line), ''), '$.completed')::BIGINT AS completed, json_extract_string(nullif(trim(line), ''), '$.error') AS error FROM {BODIES}""")
def runtime_answers(t: Tables) -> DataFrame:
    n = F.col("event_id")
    body = F.concat(F.lit('{"models":[{"name":"'), F.col("event_type"), F.lit('","size":'), F.col("user_id"), F.lit(',"details":{"embedding_length":'), n % 1024, F.lit('}},{"size":3}],"model_info":{"x.other":1,"bert.embedding_length":'), n % 768, F.lit("}}"))
    line = F.when(n % 3 == 0, F.concat(F.lit('{"status":"pulling","completed":'), n, F.lit("}"))).when(n % 3 == 1, " ").otherwise(F.concat(F.lit('{"error":"no '), F.col("event_type"), F.lit('"}')))
    models, got = D.installed_models(body), D.pull_progress(line)
    first = F.get(models, 0)
    return t.events.select("event_id", first["name"].alias("name"), first["size"].alias("size"), first.embedding_length.alias("length"), F.size(models).alias("models"), D.shown_dimension(body).alias("shown"), got.status.alias("status"), got.completed.alias("completed"), got.error.alias("error"))


ACCOUNT = "me@x.org"
GROUNDED = f"(SELECT thread_id, string_agg('--- from: ' || sender || ' | date: ' || {DAY} || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS ground FROM (SELECT 't' || (pk % 50) AS thread_id, pk AS rank, sender, date_unix, body_text AS text FROM {MESSAGES} WHERE pk % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY pk % 50 ORDER BY pk) <= 6) GROUP BY thread_id)"


@query(f"""SELECT thread_id, 'THREAD (oldest first):' || chr(10) || block || chr(10) || chr(10) || coalesce('CONTEXT:' || chr(10) || ground || chr(10) || chr(10), '')
 || 'You are drafting this reply as {ACCOUNT} ' || chr(8212) || ' the person who RECEIVED the message below, not its sender, regardless of any name or greeting used inside the message body. Draft a reply to the most recent message above, sent by ' || sender || ' on ' || day || '. Address the reply to ' || sender || '; never address it to {ACCOUNT}.' AS prompt,
 CASE WHEN length(block) % 2 = 0 THEN 'Be brief.' || chr(10) || chr(10) || 'STYLE GUIDANCE (how this user writes; match their tone and register):' || chr(10) || thread_id ELSE 'Be brief.' END AS system
 FROM (SELECT thread_id, string_agg('--- ' || sender || ' | ' || {DAY} || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY date_unix, pk) AS block, arg_max(sender, (date_unix, pk)) AS sender, arg_max({DAY}, (date_unix, pk)) AS day
 FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date_unix DESC, pk DESC) AS r FROM {THREADS}) WHERE r <= 20 GROUP BY thread_id) LEFT JOIN {GROUNDED} USING (thread_id)""")
def draft_with_context(t: Tables) -> DataFrame:
    m = t.messages.where("pk % 3 <> 0")
    ground = m.select(F.concat(F.lit("t"), F.col("pk") % 50).alias("thread_id"), F.col("pk").alias("rank"), "sender", "date_unix", F.col("body_text").alias("text"))
    rows = P.draft(t.threads, ACCOUNT, grounding=ground)
    blocks = P.draft(t.threads).select("thread_id", (F.length(F.regexp_extract("prompt", r"(?s)^[^\n]*\n(.*)\n\nDraft a reply", 1)) % 2 == 0).alias("even"))
    style = F.when(F.col("even"), F.col("thread_id"))
    return rows.join(blocks, "thread_id").select("thread_id", "prompt", P.draft_system("Be brief.", style).alias("system"))


@query(WITH + f"""SELECT qid, by_floor, by_top_k, coalesce(n, 0) - coalesce(k, 0) AS by_budget FROM (SELECT qid, count(*) FILTER (score <= 0.015) AS by_floor, count(*) FILTER (score > 0.015 AND rank > 8) AS by_top_k FROM fused GROUP BY qid)
 LEFT JOIN (SELECT qid, count(*) AS n FROM {TOP} GROUP BY qid) USING (qid) LEFT JOIN (SELECT qid, count(*) AS k FROM {TRIMMED} GROUP BY qid) USING (qid)""")
def drop_counts(t: Tables) -> DataFrame:
    found = fused(t)
    ranked = stored(top_chunks(t, found=found).drop("subject"))
    return P.drop_counts(found, ranked, P.budget_trim(ranked, 600), 0.015, 8)


REPLIES = f"(SELECT d.conv_id AS pk, 't' || d.conv_id AS thread_id, arg_min(m.pk, (m.date_unix, m.pk)) AS reply FROM (SELECT conv_id, min(date_unix) + 30 AS generated_at FROM {THREADS} GROUP BY conv_id) d JOIN {THREADS} m ON m.conv_id = d.conv_id AND contains(lower(m.sender), 'assistant@h') AND m.date_unix > d.generated_at GROUP BY d.conv_id)"


@query(f"SELECT pk, 'm' || reply AS reply_id, pk % 5 <> 0 AS learn FROM {REPLIES}")
def learning_replies(t: Tables) -> DataFrame:
    messages = t.threads.withColumn("message_id", F.concat(F.lit("m"), F.col("pk")))
    drafts = messages.groupBy(F.col("conv_id").alias("pk"), "thread_id").agg((F.min("date_unix") + 30).alias("generated_at")).withColumn("sender", F.lit("a@b.example.org"))
    replies = L.first_own_replies(drafts, messages, "Assistant@h")
    known = replies.where("pk % 5 = 0").select("thread_id", "reply_id")
    new, marked = L.fresh(replies, known)
    return new.select("pk", "reply_id", F.lit(True).alias("learn")).unionByName(marked.select("pk", "reply_id", F.lit(False).alias("learn")))


@query("""SELECT coalesce(p.scope, s.scope) AS scope, coalesce(s.text, p.text) AS profile_text, coalesce(p.n, 0) + CASE WHEN s.scope IS NULL THEN 0 ELSE 1 END AS sample_count, CASE WHEN s.scope IS NULL THEN 5 ELSE 9 END::BIGINT AS updated_at
 FROM (SELECT 'n' || n_nationkey AS scope, 'old ' || n_name AS text, n_nationkey::BIGINT AS n FROM nation) p FULL JOIN (SELECT 'n' || c_nationkey + 5 AS scope, 'style of ' || min(c_custkey) AS text FROM customer GROUP BY c_nationkey HAVING c_nationkey % 4 <> 0) s USING (scope)""")
def profile_merge(t: Tables) -> DataFrame:
    old = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("scope"), F.concat(F.lit("old "), F.col("n_name")).alias("profile_text"), F.col("n_nationkey").cast("long").alias("sample_count"), F.lit(5).cast("long").alias("updated_at"))
    asked = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("k")).select(F.concat(F.lit("n"), F.col("c_nationkey") + 5).alias("qid"), F.when(F.col("c_nationkey") % 4 == 0, "").otherwise(F.col("k").cast("string")).alias("prompt"))
    said = V.generated(asked, style_of).where("error is null").select(F.col("id").alias("scope"), F.col("answer").alias("profile_text"))
    return L.merged_profiles(old, said, 9, 1, 1)


def style_of(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a generator."""
    return [f" style of {p}\n" if p else " " for p in prompts]


@query("SELECT o_orderkey AS id, 1000000000 - coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN (epoch_us(o_orderdate) // 1000000) END, 0) >= 86400 AS due FROM orders")
def due_gates(t: Tables) -> DataFrame:
    from threadlake.functions.text import epoch

    last = F.when(F.col("o_orderkey") % 7 != 0, epoch(F.col("o_orderdate")))
    return t.orders.select(F.col("o_orderkey").alias("id"), L.due(last, 1_000_000_000).alias("due"))


@query("""WITH c AS (SELECT doc_id, (unicode(ch) % 32) AS b, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL)
 SELECT doc_id AS id, b::INT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def micro_batch_embed(t: Tables) -> DataFrame:
    got = V.embedded(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"))
    return got.where("error is null").select("id", F.posexplode("vec").alias("bucket", "v")).where("v > 0").select("id", "bucket", F.round("v", 6).alias("value"))


@query("SELECT 'customer' AS name, count(*) FILTER (c_nationkey < 20)::BIGINT AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20")
def atomic_commit(t: Tables) -> DataFrame:
    """Two tables change in one commit; a second transaction fails half-way and leaves no trace."""
    store = Store(t.spark, fresh_path(t.spark, "store"))
    with store.transaction() as first:
        first.write("customer", t.customer)
        first.write("orders", t.orders)
    with store.transaction() as second:
        second.write("customer", second.read("customer").where("c_nationkey < 20"))
        with store.transaction() as inner:
            inner.write("orders", M.cascaded(inner.read("orders"), inner.read("customer"), "o_custkey", "c_custkey"))
    try:
        with store.transaction() as third:
            third.write("customer", t.customer.limit(0))
            raise ValueError("half-way")
    except ValueError:
        pass
    count = lambda name: store.read(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
    return count("customer").unionByName(count("orders"))
