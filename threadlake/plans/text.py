"""Queries over texts: tokens, chunks, HTML, senders, rules, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.functions.vectors import cosine, hash_embedding
from threadlake.operators.activity import wrong_dimension
from threadlake.operators.chunking import chunk, register
from threadlake.operators.classify import verdict
from threadlake.operators.datescope import numeric_range, with_ranges
from threadlake.plans.base import DRAFTS, MESSAGES, SQL, START, Tables, query

TRIM = "trim({}, '" + X.EDGES + "')"
BOILER = "(?i)" + "|".join(X.BOILERPLATE)


@query(r"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')) AS t FROM documents) GROUP BY ALL")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query("SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {TRIM.format('text')} AS s FROM documents),
 c(doc_id, s, start, stop, n) AS (SELECT doc_id, s, 0::BIGINT, NULL::BIGINT, -1 FROM d WHERE s <> '' UNION ALL
  SELECT doc_id, s, nxt, CASE WHEN nxt + 2048 >= length(s) THEN length(s) ELSE nxt + coalesce(nullif(greatest(pp, 0), 0), nullif(greatest(pl, 0), 0), nullif(greatest(ps, 0), 0), 2048) END, n + 1 FROM
  (SELECT *, coalesce(1025 + 1 + length(z) - nullif(strpos(reverse(z), chr(10) || chr(10)), 0) , 0) AS pp, coalesce(1025 + 1 + length(z) - nullif(strpos(reverse(z), chr(10)), 0), 0) AS pl,
    coalesce(1024 + length(regexp_extract(substr(s, nxt + 1024 + 1, 1024), '^((?s:.*)[.!?]) ', 1)) + 1, 0) * (regexp_matches(substr(s, nxt + 1024 + 1, 1024), '[.!?] '))::INT AS ps
   FROM (SELECT *, substr(s, nxt + 1025 + 1, 1023) AS z FROM (SELECT *, CASE WHEN n < 0 THEN 0 ELSE greatest(stop - 256, start + 1) END AS nxt FROM c WHERE n < 0 OR stop < length(s))))
 ) SELECT doc_id, n AS ordinal, {TRIM.format('substr(s, start + 1, stop - start)')} AS text FROM c WHERE n >= 0""")
def chunk_documents(t: Tables) -> DataFrame:
    return chunk(t.documents, "doc_id", "text")


@query(SQL["chunk_documents"])
def chunk_lateral(t: Tables) -> DataFrame:
    """The same rows from the table function in SQL."""
    register(t.spark)
    t.documents.createOrReplaceTempView("documents_to_chunk")
    return t.spark.sql("SELECT doc_id, c.ordinal, c.text FROM documents_to_chunk d, LATERAL chunks(d.text) c")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM (
 SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^<>]*>.*?</script>', ' ', 'g'),
  '(?is)<style\b[^<>]*>.*?</style>', ' ', 'g'), '(?is)<head\b[^<>]*>.*?</head>', ' ', 'g'), '(?is)<title\b[^<>]*>.*?</title>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
  '(?i)</(?:p|div|tr|table|ul|ol|li|h[1-6]|blockquote)>|<(?:br|hr)\s*/?>', chr(10) || chr(10), 'g'), '<[^<>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS x FROM pages)""")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("SELECT doc_id, text || ' &copy; &bad &#99999999; &lt;' AS text FROM documents")
def decode_entities(t: Tables) -> DataFrame:
    """Whole documents with their signs and umlauts written as entities of each kind, and some that stay."""
    text = F.col("text")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("ä", "&auml;"), ("ö", "&ouml;"), ("Ü", "&Uuml;"), ("ß", "&#223;"), ("é", "&#xE9;"), ("e", "&#101;"), ("😀", "&#x1F600;")):
        text = F.replace(text, F.lit(sign), F.lit(entity)) if sign != "e" else F.regexp_replace(text, "e(?= )", entity)
    return t.documents.select("doc_id", X.decode_entities(F.concat(text, F.lit(" &copy; &bad &#99999999; &amp;lt;"))).alias("text"))


STRIPPED = TRIM.format(f"array_to_string(list_filter(string_split(body, chr(10) || chr(10)), lambda p: NOT regexp_matches(p, '{BOILER}')), chr(10) || chr(10))")


@query(f"SELECT doc_id, {STRIPPED} AS text FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Click to Unsubscribe here' ELSE 'kept ' || source END || chr(10) || chr(10) || text || chr(10) || chr(10) || 'hier ABMELDEN' || chr(10) || chr(10) || text AS body FROM documents)")
def strip_boilerplate(t: Tables) -> DataFrame:
    """Whole documents, twice, between paragraphs of boilerplate."""
    head = F.when(F.col("doc_id") % 2 == 0, F.lit("Click to Unsubscribe here")).otherwise(F.concat(F.lit("kept "), F.col("source")))
    text = F.concat(head, F.lit("\n\n"), F.col("text"), F.lit("\n\nhier ABMELDEN\n\n"), F.col("text"))
    return t.documents.select("doc_id", X.strip_boilerplate(text).alias("text"))


@query(f"SELECT pk, lower(regexp_extract(sender, '<([^<>]*)>', 1)) AS address, 'user' || pk % 10 || '@y' AS bare FROM {MESSAGES}")
def sender_address(t: Tables) -> DataFrame:
    bare = F.concat(F.lit("USER"), F.col("pk") % 10, F.lit("@Y"))
    return t.messages.select("pk", X.sender_address(F.col("sender")).alias("address"), X.sender_address(bare).alias("bare"))


@query(f"SELECT pk, CASE WHEN pk % 4 = 0 THEN 'Plain Name' ELSE 'example' END AS domain FROM {MESSAGES}")
def sender_domain(t: Tables) -> DataFrame:
    return t.messages.select("pk", X.sender_domain(F.when(F.col("pk") % 4 == 0, F.lit('"Plain Name"')).otherwise(F.col("sender"))).alias("domain"))


@query(f"SELECT pk FROM {MESSAGES} WHERE NOT (pk % 10 = 3 OR (pk % 10 = 5 AND sender LIKE 'User src1 %'))")
def sender_exclusion(t: Tables) -> DataFrame:
    return t.messages.where(~X.excluded(F.col("sender"), [" Mail3.example.com ", "SRC1@mail5.example.com", ""])).select("pk")


@query("SELECT doc_id, 'id-' || doc_id || '@host' AS message_id, ['a@x', 'b' || doc_id || '@y'][1] || ' ' || 'b' || doc_id || '@y' AS refs FROM documents")
def normalize_msgid(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" <id-"), F.col("doc_id"), F.lit("@host>\n"))
    refs = F.concat(F.lit("<a@x>\t <b"), F.col("doc_id"), F.lit("@y>"))
    return t.documents.select("doc_id", X.normalize_msgid(raw).alias("message_id"), F.array_join(X.references(refs), " ").alias("refs"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'open' WHEN page_id % 4 = 2 THEN 'block' WHEN page_id % 4 = 3 THEN 'block' ELSE 'confirm' END AS action FROM pages")
def link_policy(t: Tables) -> DataFrame:
    n = F.col("page_id") % 4
    url = F.when(n == 1, F.lit("Message://x")).when(n == 2, F.lit("file:///etc")).when(n == 3, F.lit("no scheme")).otherwise(F.col("url"))
    return t.pages.select("page_id", X.link_action(url).alias("action"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text FROM documents")
def cap_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.capped(F.col("text")).alias("text"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN floor(l_partkey * 3 / 4)::BIGINT ELSE l_partkey END AS bound FROM lineitem")
def decoded_bound(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), X.decoded_bound(F.when(F.col("l_linenumber") % 2 == 0, " Base64").otherwise("8bit"), F.col("l_partkey")).alias("bound"))


@query("SELECT doc_id, length(text) > 2000 AS too_long, strlen(text) > 2500 AS too_large FROM documents")
def size_guards(t: Tables) -> DataFrame:
    long, large = X.guarded(F.col("text"), 2000, 2500)
    return t.documents.select("doc_id", long.alias("too_long"), large.alias("too_large"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Ann <ann' || doc_id || '@x.org>' END AS original FROM documents")
def original_sender(t: Tables) -> DataFrame:
    marker = F.when(F.col("doc_id") % 3 == 0, "---------- Forwarded message ---------").otherwise("no marker")
    body = F.concat(F.lit("Hi\n"), marker, F.lit("\nDate: today\nFrom: Ann <ann"), F.col("doc_id"), F.lit("@x.org>\nSubject: s\n\nbody"))
    return t.documents.select("doc_id", X.original_sender(body).alias("original"))


@query(f"SELECT pk, lower(regexp_extract(sender, '<([^<>]*)>', 1)) AS quoted FROM {MESSAGES}")
def quoted_sender(t: Tables) -> DataFrame:
    return t.messages.select("pk", X.quoted_sender(F.concat(F.lit("  Am Montag schrieb "), F.col("sender"), F.lit(":\n> "), F.col("subject"))).alias("quoted"))


@query("SELECT c_custkey AS id, 'm' || c_custkey % 3 || '@v2' AS model, (c_custkey % 2 + 1)::INT * 384 AS dimensions, c_custkey % 3 = 1 AND c_custkey % 2 = 0 AS current FROM customer")
def stamp_check(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    got = X.stamp(F.concat(F.lit("m"), key % 3, F.lit("@v2@"), (key % 2 + 1) * 384))
    return t.customer.select(key.alias("id"), got.model.alias("model"), got.dimensions.alias("dimensions"), (X.same_model(got.model, F.lit("m1@v2:latest")) & (got.dimensions == 384)).alias("current"))


@query("SELECT c_custkey AS id, (least(greatest(floor(abs(c_acctbal) / 500 * 1000 / 512 + 0.5) * 512, 2048), 16384))::BIGINT AS context, CASE WHEN least(greatest(floor(abs(c_acctbal) / 500 * 1000 / 512 + 0.5) * 512, 2048), 16384) >= 8192 THEN 1000 ELSE 800 END AS answer FROM customer")
def token_advisor(t: Tables) -> DataFrame:
    context, answer = X.token_advice(F.abs("c_acctbal") / 500)
    return t.customer.select(F.col("c_custkey").alias("id"), context.alias("context"), answer.alias("answer"))


@query(f"SELECT pk, strftime(make_timestamp(date_unix * 1000000), '%Y-%m-%d') AS day FROM {MESSAGES}")
def render_ymd(t: Tables) -> DataFrame:
    return t.messages.select("pk", X.date_text(F.col("date_unix")).alias("day"))


@query(f"SELECT pk, CASE pk % 4 WHEN 0 THEN date_unix - 3600 WHEN 1 THEN date_unix + 19800 WHEN 2 THEN date_unix // 60 * 60 END AS parsed FROM {MESSAGES}")
def parse_rfc5322(t: Tables) -> DataFrame:
    """Every form of the date header, with its weekday: a zone and a comment, no weekday, no seconds, and one that is no date."""
    at, n = F.to_utc_timestamp(F.timestamp_seconds("date_unix"), F.current_timezone()), F.col("pk") % 4
    shown = lambda pattern, zone: F.concat(F.date_format(at, pattern), F.lit(zone))
    raw = F.when(n == 0, shown("E, dd MMM yyyy HH:mm:ss", " +0100 (CET)")).when(n == 1, shown("d MMM yyyy HH:mm:ss", " -0530")).when(n == 2, shown("E, dd MMM yyyy HH:mm", " +0000")).otherwise(shown("E, 99 MMM yyyy HH:mm:ss", " +0000"))
    return t.messages.select("pk", X.mail_date(raw).alias("parsed"))


@query("SELECT o_orderkey AS id, (epoch_us(o_orderdate) // 1000000) - 978307200 AS cocoa FROM orders")
def cocoa_shift(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), X.cocoa_seconds(X.epoch(F.col("o_orderdate"))).alias("cocoa"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INT AS keys FROM events")
def json_props(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.element_at(F.map_values(parsed), 1).alias("first_value"), F.size(parsed).alias("keys"))


@query("SELECT doc_id, text FROM documents")
def decode_qp(t: Tables) -> DataFrame:
    """Whole documents, encoded byte by byte where they are not plain ASCII, with soft line breaks."""
    from threadlake.functions.mime import quoted_printable

    pieces = F.regexp_extract_all("text", F.lit(r"(?s)[ -<>-~\n]+|."), F.lit(0))
    coded = F.transform(pieces, lambda p: F.when(p.rlike(r"^[ -<>-~\n]+$"), p).otherwise(F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "=$1")))
    raw = F.regexp_replace(F.array_join(coded, ""), "(=C3)", "$1=\n")
    return t.documents.select("doc_id", quoted_printable(raw).alias("text"))


def rule_rows(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    sender = F.when(n % 11 == 0, "News <newsletter@x.org>").when(n % 11 == 1, "no-reply@x.org").when(n % 11 == 2, "Updates <updates-1@shop.de>").when(n % 11 == 3, "a@ads.bad.com").otherwise("Ann <ann@x.org>")
    body = X.trimmed(F.concat(F.coalesce("text", F.lit("")), F.when(n % 4 == 0, "\n\nUnsubscribe now").otherwise("")))
    what, why = verdict(sender, body, n % 13 == 0, F.when(n % 17 == 0, "auto-replied").when(n % 17 == 1, "no"), F.when(n % 19 == 0, "<mailto:u@x>"), F.lit(None).cast("string"), F.when(n % 23 == 0, " Bulk "), ["bad.com"])
    return t.documents.select("doc_id", what.alias("verdict"), why.alias("reason"))


RULES = """SELECT doc_id, CASE WHEN r = 'auto_submitted' THEN 'auto_generated' WHEN r LIKE 'prior Sent%' OR r LIKE 'no newsletter%' THEN 'personal' WHEN r = 'one weak sign' THEN 'ambiguous' ELSE 'newsletter' END AS verdict, r AS reason FROM (SELECT doc_id, CASE
 WHEN doc_id % 17 = 0 THEN 'auto_submitted' WHEN doc_id % 11 = 1 THEN 'no_reply_sender' WHEN doc_id % 11 = 0 THEN 'newsletter_address' WHEN doc_id % 11 = 3 THEN 'excluded' WHEN doc_id % 13 = 0 THEN 'prior Sent correspondence with this address'
 WHEN doc_id % 19 = 0 THEN 'List-Unsubscribe present' WHEN doc_id % 23 = 0 THEN 'Precedence: bulk' WHEN doc_id % 11 = 2 AND shrinks THEN 'sender local-part pattern + unsubscribe-language boilerplate'
 WHEN doc_id % 11 = 2 OR shrinks THEN 'one weak sign' ELSE 'no newsletter signals detected' END AS r FROM (SELECT doc_id, coalesce(length({kept}) < length(body), false) AS shrinks FROM (SELECT doc_id, {body} AS body FROM documents)))""".format(
 kept=TRIM.format(f"array_to_string(list_filter(string_split(body, chr(10) || chr(10)), lambda p: NOT regexp_matches(p, '{BOILER}')), chr(10) || chr(10))"), body=TRIM.format("coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) || 'Unsubscribe now' ELSE '' END"))


@query(RULES)
def classify_messages(t: Tables) -> DataFrame:
    return rule_rows(t)


@query(f"SELECT verdict, count(*) AS messages, sum(quality)::BIGINT AS good, round(avg(quality), 6) AS rate FROM ({RULES}) JOIN labels USING (doc_id) GROUP BY verdict")
def classifier_metrics(t: Tables) -> DataFrame:
    return rule_rows(t).join(t.labels, "doc_id").groupBy("verdict").agg(F.count("*").alias("messages"), F.sum("quality").alias("good"), F.round(F.avg("quality"), 6).alias("rate"))


HEADERS = ["auto-generated", " Auto-Replied\t", "no", "", "auto-notified", "yes"]


@query("SELECT doc_id, doc_id % 7 IN (0, 1) AS automatic FROM documents")
def auto_submitted(t: Tables) -> DataFrame:
    """Every value of the header that occurs, and none at all: two of them alone keep a reply from being drafted."""
    n = F.col("doc_id") % 7
    value = F.element_at(F.array(*[F.lit(h) for h in HEADERS], F.lit(None)), (n + 1).cast("int"))
    none = F.lit(None).cast("string")
    what, _ = verdict(F.lit("Ann <ann@x.org>"), F.lit("hello"), F.lit(False), value, none, none, none)
    return t.documents.select("doc_id", (what == "auto_generated").alias("automatic"))


@query("SELECT doc_id, 2097152 - 10 + doc_id % 20 AS asked, least(2097152 - 10 + doc_id % 20, 2097152) AS kept FROM documents")
def html_cap(t: Tables) -> DataFrame:
    """Pages around the cap of two mebibytes keep what is within it; pages of one size are made once."""
    rows = t.documents.select("doc_id", (F.lit(2 * 1024 * 1024 - 10) + F.col("doc_id") % 20).cast("int").alias("size"))
    pages = rows.select("size").distinct()
    kept = pages.select("size", F.length(X.truncated_utf8(F.repeat(F.lit("x"), F.col("size")))).cast("long").alias("kept"))
    return rows.join(F.broadcast(kept), "size").select("doc_id", F.col("size").cast("long").alias("asked"), "kept")


# Questions of each form, first and last day of the range (no first: open; neither: none), as of Thursday, 28 May 2026.
DATE_FORMS = [
    ("What was the February 2026 newsletter highlight?", "2026-02-01", "2026-02-28"), ("Was war das Highlight im Februar 2026?", "2026-02-01", "2026-02-28"), ("the February newsletter", "2026-02-01", "2026-02-28"),
    ("the December summary", "2025-12-01", "2025-12-31"), ("What did the vendor say about pricing?", None, None), ("what emails did i get during on 2026-06-10?", "2026-06-10", "2026-06-10"),
    ("was bekam ich am 10.06.2026?", "2026-06-10", "2026-06-10"), ("what emails did i get during the first week of June this year?", "2026-06-01", "2026-06-07"), ("what did I get the last week of June 2026?", "2026-06-24", "2026-06-30"),
    ("the March newsletter last year", "2025-03-01", "2025-03-31"), ("the December summary this year", "2026-12-01", "2026-12-31"), ("what emails did I get this year?", "2026-01-01", "2026-12-31"),
    ("what emails did I get last year?", "2025-01-01", "2025-12-31"), ("was bekam ich im letzten Jahr?", "2025-01-01", "2025-12-31"), ("what did I get over the past four months?", "2026-01-28", "2026-05-28"),
    ("what did I get in the past 15 months?", "2025-02-28", "2026-05-28"), ("what emails came in over the past 2 years?", "2024-05-28", "2026-05-28"), ("the last 3 months", "2026-02-28", "2026-05-28"),
    ("what emails did I get yesterday?", "2026-05-27", "2026-05-27"), ("what did I get last Tuesday?", "2026-05-26", "2026-05-26"), ("anything from Tuesday?", "2026-05-26", "2026-05-26"),
    ("emails i got yesterday? or last tuesday?", "2026-05-26", "2026-05-27"), ("what did I get today?", "2026-05-28", "2026-05-28"), ("what did I get on 13/05/2026?", "2026-05-13", "2026-05-13"),
    ("what did I get on 03/04/2026?", None, None), ("what did I get on 04/03/2026?", None, None), ("what did I get on 05/05/2026?", None, None), ("what emails did I get on June 5th this year?", "2026-06-05", "2026-06-05"),
    ("was bekam ich am 5. Juni?", "2025-06-05", "2025-06-05"), ("the 5th of June, did I get anything?", "2025-06-05", "2025-06-05"), ("the 1st week of June 2026", "2026-06-01", "2026-06-07"),
    ("did I get anything in March or April?", "2026-03-01", "2026-04-30"), ("emails from November or December last year", "2025-11-01", "2025-12-31"), ("emails since 2026-05-01", "2026-05-01", "2026-05-28"),
    ("everything before 2026-06-01", "", "2026-06-01"), ("was bekam ich seit gestern?", "2026-05-27", "2026-05-28"), ("vor 3 Tagen", None, None), ("Ich habe Angst vor Spinnen", None, None),
    ("emails on 2026-06-01, 2026-06-05, or 2026-06-10", "2026-06-01", "2026-06-10"), ("the May newsletter", "2026-05-01", "2026-05-31"), ("what did I get in the past month?", "2026-04-28", "2026-05-28"),
    ("march 5 to march 9", "2026-03-05", "2026-03-09"), ("5 or 7 march", "2026-03-05", "2026-03-07"), ("between march 5th and april 9th", "2026-03-05", "2026-04-09"),
    ("until 2026-02-01 or since monday", "", "2026-02-01"), ("since monday until tuesday", "2026-05-25", "2026-05-28"), ("2026-02-31", "2026-03-03", "2026-03-03"),
]
FORM_ROWS = ", ".join("({}, {}, {})".format(i, *("NULL" if d is None else "'1970-01-01'" if d == "" else f"'{d}'" for d in days)) for i, (_, *days) in enumerate(DATE_FORMS))


@query(f"""SELECT doc_id AS qid, epoch(lo::DATE)::BIGINT AS lo, epoch(hi::DATE)::BIGINT + 86399 AS hi FROM documents JOIN (VALUES {FORM_ROWS}) v(form, lo, hi) ON form = doc_id % {len(DATE_FORMS)}""")
def date_forms(t: Tables) -> DataFrame:
    """Every form of a date in a question, each asked by the documents of one remainder."""
    n = F.col("doc_id") % len(DATE_FORMS)
    asked = t.documents.select(F.col("doc_id").alias("qid"), F.element_at(F.array(*[F.lit(q) for q, _, _ in DATE_FORMS]), (n + 1).cast("int")).alias("question"))
    return with_ranges(asked, now=1779969600)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE epoch(make_date(2024, (doc_id % 12 + 1)::INT, (doc_id % 28 + 1)::INT))::BIGINT END AS lo,
 CASE WHEN doc_id % 4 = 3 THEN NULL ELSE epoch(make_date(2024, (doc_id % 12 + 1)::INT, (doc_id % 28 + 1)::INT))::BIGINT + 86399 END AS hi FROM documents""")
def date_range_numeric(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    d, m = F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lpad((n % 12 + 1).cast("string"), 2, "0")
    shown = F.when(n % 4 == 0, F.concat(F.lit("2024-"), m, F.lit("-"), d)).when(n % 4 == 1, F.concat(d, F.lit("."), m, F.lit(".2024"))).when(n % 4 == 2, F.concat(F.lit("on 2024-"), m, F.lit("-"), d, F.lit(" maybe"))).otherwise("no day")
    r = numeric_range(F.concat(F.lit("mail of "), shown))
    return t.documents.select("doc_id", r.lo.alias("lo"), r.hi.alias("hi"))


DAYS = "epoch(make_date({}, {}, {}))::BIGINT"
NOW_DAY = f"((({START} + 70000000) // 86400) * 86400)"  # a Saturday, whose Monday is five days back


@query(f"""SELECT doc_id AS qid, CASE f WHEN 0 THEN {NOW_DAY} - 5 * 86400 WHEN 1 THEN {DAYS.format(2024, 'm', 1)} WHEN 2 THEN {NOW_DAY} - m * 7 * 86400 WHEN 3 THEN 0
  WHEN 4 THEN {DAYS.format(2025, 'm', 1)} WHEN 5 THEN {DAYS.format(2025, 3, 25)} WHEN 6 THEN {DAYS.format(2025, 3, 5)} END AS lo,
 CASE f WHEN 0 THEN {NOW_DAY} + 86399 WHEN 1 THEN epoch(make_date(2024, m, 1) + INTERVAL 1 MONTH)::BIGINT - 1 WHEN 2 THEN {NOW_DAY} + 86399 WHEN 3 THEN {DAYS.format(2026, 'm', 'd')} + 86399
  WHEN 4 THEN {DAYS.format(2025, 'm', 7)} + 86399 WHEN 5 THEN {DAYS.format(2025, 3, 31)} + 86399 WHEN 6 THEN {DAYS.format(2025, 6, 10)} + 86399 END AS hi
 FROM (SELECT doc_id, doc_id % 8 AS f, (doc_id % 12 + 1)::INT AS m, (doc_id % 28 + 1)::INT AS d FROM documents)""")
def date_range(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    d, m = F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lpad((n % 12 + 1).cast("string"), 2, "0")
    months = F.array(*[F.lit(x) for x in ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")])
    month = F.element_at(months, (n % 12 + 1).cast("int"))
    question = (
        F.when(n % 8 == 0, "mails since monday").when(n % 8 == 1, F.concat(F.lit("invoices of "), month, F.lit(" 2024")))
        .when(n % 8 == 2, F.concat(F.lit("was kam letzte "), n % 12 + 1, F.lit(" Wochen?"))).when(n % 8 == 3, F.concat(F.lit("before 2026-"), m, F.lit("-"), d))
        .when(n % 8 == 4, F.concat(F.lit("first week of "), month, F.lit(" or april 2025"))).when(n % 8 == 5, "last week of march and march 2025")
        .when(n % 8 == 6, "march 5 or 10.06.2025").otherwise("nothing")
    )
    asked = t.documents.select(n.alias("qid"), question.alias("question"))
    return with_ranges(asked, now=START + 70_000_000)


@query(
    "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q")
def cosine_similarity(t: Tables) -> DataFrame:
    one = F.array(*[F.lit(float(x)) for x in t.embeddings.where("vec_id = 7").first().embedding])
    return t.embeddings.select("vec_id", F.round(cosine(F.col("embedding"), one), 6).alias("score"))


@query("SELECT label, count(*) AS vectors, (count(*) FILTER (len(embedding) <> 64))::BIGINT AS dropped FROM embeddings GROUP BY label")
def vector_dim_guard(t: Tables) -> DataFrame:
    return wrong_dimension(t.embeddings, "label", 64)


@query("""WITH c AS (SELECT item_id, (unicode(ch) % 32) AS b, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark) GROUP BY ALL)
 SELECT item_id, b::INT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM c""")
def hash_embed(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", F.posexplode(hash_embedding(F.col("text"))).alias("bucket", "v"))
    return rows.where("v > 0").select("item_id", "bucket", F.round("v", 6).alias("value"))


SELECTIONS = f"(SELECT pk, lower(regexp_extract(sender, '<([^<>]*)>', 1)) AS address, trim(regexp_replace(lower(substr('Am Montag schrieb ' || sender || ':' || chr(10) || '> ' || coalesce(body_text, ''), 1, 20000)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS said FROM {MESSAGES} WHERE pk % 100 = 0)"
ANSWERED = f"(SELECT pk AS draft, lower(regexp_extract(sender, '<([^<>]*)>', 1)) AS address, date_unix AS made, substr(trim(regexp_replace(lower(coalesce(body_text, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 80) AS opening FROM {MESSAGES})"


@query(f"""SELECT pk, arg_max(draft, (common, made, draft)) AS draft FROM (SELECT s.pk, a.draft, a.made, CASE WHEN length(opening) >= 20 AND contains(said, opening) THEN length(opening) ELSE 0 END AS common
 FROM {SELECTIONS} s LEFT JOIN {ANSWERED} a USING (address)) GROUP BY pk""")
def match_selection(t: Tables) -> DataFrame:
    """Each message divisible by 100 is quoted whole; every message has a ready draft that answers it."""
    from threadlake.operators.selection import match

    m = t.messages
    quoted = F.concat(F.lit("Am Montag schrieb "), F.col("sender"), F.lit(":\n> "), F.coalesce("body_text", F.lit("")))
    asked = m.where("pk % 100 = 0").select("pk", quoted.alias("selection"))
    drafts = m.select(F.col("pk").alias("draft"), "sender", F.col("date_unix").alias("generated_at"), F.col("body_text").alias("body"))
    return match(asked, drafts)
