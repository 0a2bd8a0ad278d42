"""Queries for retrieval and context assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.operators import dated as D
from threadlake.operators import evals as E
from threadlake.operators import index as I
from threadlake.operators import prompt as P
from threadlake.operators import search as S
from threadlake.operators import vectors_index as VI
from threadlake.plans.base import MESSAGES, QUESTIONS, START, THREADS, Tables, query
from threadlake.sources.shared import fresh_path, sized, stored

# Question q asks with the vector of number 3q + 1; vector i is chunk i.
TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"
POSTINGS = f"(SELECT doc_id AS chunk_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM (SELECT doc_id, {TERMS.format('text')} AS w FROM documents)) GROUP BY ALL)"
KEYWORD = f"""SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
 SELECT qid, chunk_id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
 FROM {POSTINGS} p JOIN (SELECT term, count(*) AS df FROM {POSTINGS} GROUP BY term) USING (term) JOIN (SELECT qid, unnest({TERMS.format('question')}) AS term FROM {QUESTIONS}) q USING (term)
 CROSS JOIN (SELECT count(*) AS n, avg(len({TERMS.format('text')})) AS avgdl FROM documents) GROUP BY qid, chunk_id) QUALIFY rank <= 30"""
UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
VECTOR = f"""SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
 SELECT b.item_id AS qid, e.vec_id AS chunk_id, round(list_dot_product({UNIT.replace('embedding', 'e.embedding')}, {UNIT.replace('embedding', 'q.embedding')}) / sqrt(list_dot_product({UNIT.replace('embedding', 'e.embedding')}, {UNIT.replace('embedding', 'e.embedding')}))
 / sqrt(list_dot_product({UNIT.replace('embedding', 'q.embedding')}, {UNIT.replace('embedding', 'q.embedding')})), 6) + 0.0 AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id * 3 + 1 CROSS JOIN embeddings e) QUALIFY rank <= 30"""
FUSED = f"""SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS rank FROM (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank + list * 1000000) AS seen
 FROM (SELECT *, 0 AS list FROM ({VECTOR}) UNION ALL SELECT *, 1 AS list FROM ({KEYWORD})) GROUP BY qid, chunk_id)"""
WITH = f"WITH fused AS MATERIALIZED ({FUSED}), m AS {MESSAGES}\n"


KEPT: dict[tuple[str, str, str], str] = {}  # written once for each session and folder of tables


def index(t: Tables) -> I.KeywordIndex:
    """The stored index of the documents."""
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    return I.KeywordIndex(t.spark, kept(t, "index", lambda path: I.KeywordIndex(t.spark, path).append(docs)))


def chunks_by_date(t: Tables) -> DataFrame:
    """The stored chunks by month."""
    rows = t.messages.select(F.col("pk").alias("chunk_id"), "date_unix")
    return D.read(t.spark, kept(t, "dated", lambda path: D.write(rows, path)))


def keyword(t: Tables) -> DataFrame:
    return index(t).search(t.questions)


def kept(t: Tables, kind: str, write: Callable[[str], None]) -> str:
    """The folder of a table that a session writes when it first asks for it."""
    at = (kind, t.spark.sparkContext.applicationId, t.sf_dir)
    if at not in KEPT:
        path = fresh_path(t.spark, kind)
        write(path)
        KEPT[at] = path
    return KEPT[at]


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


def vector(t: Tables) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("qid"), (F.col("item_id") * 3 + 1).alias("vec_id")).join(t.embeddings, "vec_id").select("qid", F.col("embedding").alias("vec"))
    return S.vector_search(asked, vectors(t))


def fused(t: Tables) -> DataFrame:
    """Some sixty rows for each question, written once: most plans read them several times."""
    return stored(S.fuse(vector(t), keyword(t)))


def top_chunks(t: Tables, k: int = 8, found: DataFrame | None = None) -> DataFrame:
    """Hits with their message; two chunks make a message, so that messages repeat."""
    hits = S.above_floor(fused(t) if found is None else found).where(F.col("rank") <= k)
    m = t.messages.select(F.col("pk").alias("chunk_id"), F.concat(F.lit("msg-"), F.floor(F.col("pk") / 2)).alias("message_id"), "subject", "sender", "original_sender", "date_unix", F.col("body_text").alias("text"), F.lit("body").alias("source"))
    return sized(hits, 60).join(m, "chunk_id")


TOP = f"(SELECT f.qid, f.chunk_id, f.score, f.rank, 'msg-' || pk // 2 AS message_id, subject, sender, original_sender, date_unix, body_text AS text FROM fused f JOIN m ON pk = chunk_id WHERE rank <= 8)"
DAY = "strftime(make_timestamp(date_unix * 1000000), '%Y-%m-%d')"


def shown(number: str) -> str:
    return f"""'--- [' || {number} || '] from: ' || coalesce(original_sender, sender) || CASE WHEN original_sender IS NULL THEN '' ELSE ' (forwarded by ' || sender || ')' END || ' | date: ' || {DAY} || ' | source: body ---'
 || chr(10) || 'BEGIN EMAIL [' || {number} || ']' || chr(10) || text || chr(10) || 'END EMAIL [' || {number} || ']'"""


NUMBERED = f"(SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY first) AS number FROM (SELECT *, min(rank) OVER (PARTITION BY qid, message_id) AS first FROM kept))"
TRIMMED = f"(SELECT * FROM (SELECT *, sum((length({shown('99')}) + 3) // 4) OVER (PARTITION BY qid ORDER BY rank) AS running, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM {TOP}) WHERE running <= 600 OR nth = 1)"


@query(KEYWORD)
def keyword_search(t: Tables) -> DataFrame:
    return keyword(t).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT count(*) AS n, round(avg(len({TERMS.format('text')})), 6) AS avgdl FROM documents")
def bm25_stats(t: Tables) -> DataFrame:
    return S.corpus_stats(t.documents).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(VECTOR)
def vector_search(t: Tables) -> DataFrame:
    return vector(t).withColumn("rank", F.col("rank").cast("long"))


@query(VECTOR)
def vector_index_search(t: Tables) -> DataFrame:
    """The same from the stored clusters."""
    asked = t.benchmark.select(F.col("item_id").alias("qid"), (F.col("item_id") * 3 + 1).alias("vec_id")).join(t.embeddings, "vec_id").select("qid", F.col("embedding").alias("vec"))
    path = kept(t, "clusters", lambda path: VI.VectorIndex(t.spark, path).build(vectors(t), 64))
    return VI.VectorIndex(t.spark, path).search(asked).withColumn("rank", F.col("rank").cast("long"))


CHANGED = f"(SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 6 <> 1)"


@query(KEYWORD.replace("documents", CHANGED))
def keyword_search_changed(t: Tables) -> DataFrame:
    """A third of the chunks is replaced or deleted; the rest of the index stays as it was written."""
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    found = I.KeywordIndex(t.spark, fresh_path(t.spark, "index"))
    found.append(docs)
    found.replace(docs.where("chunk_id % 6 = 0").withColumn("text", F.reverse("text")))
    found.delete(docs.where("chunk_id % 6 = 1"))
    return found.search(t.questions).withColumn("rank", F.col("rank").cast("long"))


SCOPE_FORMS = f"(SELECT doc_id AS qid, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 4 THEN {START} + 9 ELSE {START} + doc_id * 3600 - 86400 * (doc_id % 5) END AS lo, CASE doc_id % 5 WHEN 3 THEN 1 WHEN 4 THEN 99999999999 ELSE {START} + doc_id * 3600 + 864000 END AS hi FROM documents WHERE doc_id % 10 < 5)"


@query(f"SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY date_unix, chunk_id) AS position FROM (SELECT qid, pk AS chunk_id, date_unix FROM {SCOPE_FORMS} JOIN {MESSAGES} ON date_unix BETWEEN lo AND hi) QUALIFY position <= 8")
def oldest_in_range(t: Tables) -> DataFrame:
    """Half of the messages ask for a range each: narrow ones, open ones at either end, and empty ones."""
    n = F.col("doc_id")
    lo = F.when(n % 5 == 0, 0).when(n % 5 == 4, START + 9).otherwise(START + n * 3600 - 86400 * (n % 5)).cast("long")
    hi = F.when(n % 5 == 3, 1).when(n % 5 == 4, 99999999999).otherwise(START + n * 3600 + 864000).cast("long")
    ranges = t.documents.where("doc_id % 10 < 5").select(n.alias("qid"), lo.alias("lo"), hi.alias("hi"))
    return D.oldest_in(ranges, chunks_by_date(t), 8).select("qid", "chunk_id", F.col("at").cast("long").alias("position"))


@query(WITH + "SELECT * FROM fused")
def rrf_fusion(t: Tables) -> DataFrame:
    return fused(t).withColumn("rank", F.col("rank").cast("long"))


@query(WITH + "SELECT qid, chunk_id, score, rank, message_id, date_unix FROM fused JOIN m ON pk = chunk_id WHERE score > 0 AND rank <= 8")
def hybrid_search(t: Tables) -> DataFrame:
    hits = S.above_floor(fused(t)).where(F.col("rank") <= S.TOP_K)
    m = t.messages.select(F.col("pk").alias("chunk_id"), "message_id", "date_unix")
    return sized(hits, 60).join(m, "chunk_id").select("qid", "chunk_id", "score", F.col("rank").cast("long"), "message_id", "date_unix")


@query(WITH + "SELECT qid, count(*) AS kept FROM fused WHERE score > 0.015 GROUP BY qid")
def relevance_floor(t: Tables) -> DataFrame:
    return S.above_floor(fused(t), 0.015).groupBy("qid").agg(F.count("*").alias("kept"))


@query(WITH + "SELECT qid, chunk_id, score FROM fused WHERE chunk_id NOT IN (qid * 3 + 1, qid, qid * 7, qid + 20)")
def retrieve_excluding(t: Tables) -> DataFrame:
    """Each question leaves out a few chunks: its own thread, as it were."""
    n = F.col("item_id")
    out = t.benchmark.select(n.alias("qid"), F.explode(F.array(n * 3 + 1, n, n * 7, n + 20)).alias("chunk_id"))
    return S.without(fused(t), out).select("qid", "chunk_id", "score")


SCOPES = f"(SELECT item_id AS qid, CASE WHEN item_id % 4 <> 0 THEN CASE WHEN item_id % 4 = 3 THEN 1 ELSE {START} + item_id * 7200 END END AS lo, CASE WHEN item_id % 4 <> 0 THEN CASE WHEN item_id % 4 = 3 THEN 2 ELSE {START} + item_id * 7200 + 400000 END END AS hi FROM benchmark)"
SCOPED = WITH.rstrip() + f""", scopes AS {SCOPES}, hits AS (SELECT f.*, date_unix, lo, hi FROM fused f JOIN m ON pk = chunk_id JOIN scopes USING (qid)), inside AS (SELECT * FROM hits WHERE lo IS NULL OR date_unix BETWEEN lo AND hi),
 direct AS (SELECT qid, pk AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY date_unix, pk) AS nth FROM m JOIN scopes ON date_unix BETWEEN lo AND hi QUALIFY nth <= 8),
 merged AS (SELECT qid, chunk_id, score, CASE WHEN d.nth IS NULL THEN 'semantic' ELSE 'semantic+date' END AS provenance, 0 AS block, rank AS pos FROM inside LEFT JOIN direct d USING (qid, chunk_id)
  UNION ALL SELECT qid, chunk_id, 0.0, 'date', 1, nth FROM direct WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.qid = direct.qid AND i.chunk_id = direct.chunk_id)),
 every AS (SELECT * FROM merged UNION ALL SELECT qid, chunk_id, score, 'semantic', 0, rank FROM hits WHERE qid NOT IN (SELECT qid FROM merged)),
 final AS (SELECT qid, chunk_id, score, provenance, row_number() OVER (PARTITION BY qid ORDER BY block, pos) AS position FROM every QUALIFY position <= 8) """


def scoped(t: Tables) -> DataFrame:
    n = F.col("item_id")
    lo = F.when(n % 4 != 0, F.when(n % 4 == 3, F.lit(1)).otherwise(F.lit(START) + n * 7200)).cast("long")
    hi = F.when(n % 4 != 0, F.when(n % 4 == 3, F.lit(2)).otherwise(F.lit(START) + n * 7200 + 400000)).cast("long")
    ranges = t.benchmark.select(n.alias("qid"), lo.alias("lo"), hi.alias("hi"))
    return S.date_scoped(fused(t), chunks_by_date(t), ranges)


@query(SCOPED + "SELECT qid, chunk_id, score, position FROM final")
def hybrid_date_scoped(t: Tables) -> DataFrame:
    return scoped(t).select("qid", "chunk_id", "score", F.col("position").cast("long"))


@query(SCOPED + "SELECT qid, provenance, count(*) AS rows FROM final GROUP BY ALL")
def retrieval_provenance(t: Tables) -> DataFrame:
    return scoped(t).groupBy("qid", "provenance").agg(F.count("*").alias("rows"))


@query(f"WITH k AS MATERIALIZED (SELECT DISTINCT qid FROM ({KEYWORD})) SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 OR k.qid IS NULL THEN '{P.NO_MATCH}' END AS notice FROM benchmark LEFT JOIN k ON k.qid = item_id")
def no_match(t: Tables) -> DataFrame:
    asked = t.questions.withColumn("question", F.when(F.col("qid") % 5 == 0, "?!").otherwise(F.col("question")))
    found = index(t).search(asked).select("qid").distinct().withColumn("hit", F.lit(True))
    return t.questions.select("qid").join(found, "qid", "left").select("qid", F.when(F.col("hit").isNull(), P.NO_MATCH).alias("notice"))


@query(f"WITH k AS MATERIALIZED ({KEYWORD}), truth AS (SELECT item_id AS qid, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT count(*) AS pairs, (count(k.rank))::BIGINT AS found, round(count(k.rank) / count(*), 6) AS recall FROM truth LEFT JOIN k ON k.qid = truth.qid AND k.chunk_id = truth.chunk_id AND k.rank <= 8")
def recall_at_k(t: Tables) -> DataFrame:
    items = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    truth = S.containing(items, t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), index(t))
    hits = keyword(t).where(F.col("rank") <= 8).select("qid", "chunk_id", "rank")
    return truth.join(hits, ["qid", "chunk_id"], "left").agg(F.count("*").alias("pairs"), F.count("rank").alias("found"), F.round(F.count("rank") / F.count("*"), 6).alias("recall"))


@query(WITH + f"SELECT qid, chunk_id, rank, running::BIGINT AS running FROM {TRIMMED}")
def budget_trim(t: Tables) -> DataFrame:
    return P.budget_trim(top_chunks(t), 600).select("qid", "chunk_id", F.col("rank").cast("long"), "running")


@query(WITH.rstrip() + f", kept AS {TOP} SELECT qid, chunk_id, number FROM {NUMBERED}")
def citation_numbers(t: Tables) -> DataFrame:
    return P.citation_numbers(top_chunks(t)).select("qid", "chunk_id", F.col("number").cast("long"))


@query(WITH + f"SELECT qid, message_id, arg_min(chunk_id, rank) AS chunk_id, arg_min(score, rank) AS score FROM {TOP} GROUP BY ALL")
def best_chunk_per_message(t: Tables) -> DataFrame:
    return P.best_chunks(top_chunks(t)).select("qid", "message_id", "chunk_id", "score")


CONTEXT = WITH.rstrip() + f", kept AS {TRIMMED}, blocks AS (SELECT qid, string_agg({shown('number')}, chr(10) || chr(10) ORDER BY rank) AS context FROM {NUMBERED} GROUP BY qid) "


def contexts(t: Tables) -> DataFrame:
    return P.context_block(P.citation_numbers(P.budget_trim(top_chunks(t), 600)))


@query(CONTEXT + "SELECT * FROM blocks")
def context_block(t: Tables) -> DataFrame:
    return contexts(t)


SESSION = f"""(SELECT conv_id AS sid, 'Earlier in this conversation:' || chr(10) || string_agg('Q: ' || q || chr(10) || 'A: ' || a, chr(10) ORDER BY turn) AS session FROM (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn DESC) AS back
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user') WHERE back <= 3 GROUP BY conv_id)"""


def sessions(t: Tables) -> DataFrame:
    ahead = Window.partitionBy("conv_id").orderBy("turn")
    nxt = F.lead(F.struct("turn", "role", "text")).over(ahead)
    pairs = t.conversations.withColumn("n", nxt).where("role = 'user' AND n.role = 'assistant' AND n.turn = turn + 1")
    return P.session_block(pairs.select(F.col("conv_id").alias("sid"), "turn", F.col("text").alias("question"), F.col("n.text").alias("answer")))


@query(f"SELECT * FROM {SESSION}")
def session_block(t: Tables) -> DataFrame:
    return sessions(t)


@query(CONTEXT + f", s AS {SESSION} SELECT q.qid, coalesce(coalesce(session || chr(10) || chr(10), '') || 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question, '{P.NO_MATCH}') AS prompt, context IS NOT NULL AS matched FROM {QUESTIONS} q LEFT JOIN blocks USING (qid) LEFT JOIN s ON sid = q.qid")
def assemble_prompt(t: Tables) -> DataFrame:
    return P.assemble(t.questions.select("qid", "question"), contexts(t), sessions(t))


@query(f"""SELECT thread_id, 'THREAD (oldest first):' || chr(10) || string_agg('--- ' || sender || ' | ' || {DAY} || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY date_unix, pk) || chr(10) || chr(10)
 || 'Draft a reply to the most recent message above, from ' || arg_max(sender, (date_unix, pk)) || ', dated ' || arg_max({DAY}, (date_unix, pk)) || '.' AS prompt
 FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date_unix DESC, pk DESC) AS r FROM {THREADS}) WHERE r <= 20 GROUP BY thread_id""")
def assemble_draft(t: Tables) -> DataFrame:
    return P.draft(t.threads)


@query(WITH + "SELECT qid, chunk_id, floor(score / max(score) OVER (PARTITION BY qid) * 100 + 0.5)::BIGINT AS percent FROM fused WHERE rank <= 8")
def relevance_percent(t: Tables) -> DataFrame:
    return P.relevance_percent(fused(t).where("rank <= 8")).select("qid", "chunk_id", "percent")


SOURCES = WITH.rstrip() + f""", kept AS {TOP}, lines AS (SELECT qid, number, number || '  ' || regexp_extract(regexp_extract(coalesce(original_sender, sender), '([^\\s<>]+@[^\\s<>]+)', 1), '([^.@]+)\\.[^.@]+$', 1) || ' (' || {DAY} || '): ' || subject || chr(10) || '"' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '"' AS line
 FROM {NUMBERED} QUALIFY row_number() OVER (PARTITION BY qid, message_id ORDER BY rank) = 1) """


def source_lines(t: Tables) -> DataFrame:
    first = P.best_chunks(P.citation_numbers(top_chunks(t)))
    return first.select("qid", F.col("number").cast("long"), P.source_line().alias("line"))


@query(SOURCES + "SELECT * FROM lines")
def source_list(t: Tables) -> DataFrame:
    return source_lines(t)


@query(SOURCES + "SELECT qid, string_agg(line, chr(10) ORDER BY number) AS text FROM lines GROUP BY qid")
def export_sources(t: Tables) -> DataFrame:
    rows = source_lines(t).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("l"))
    return rows.select("qid", F.array_join(F.transform("l", lambda r: r.line), "\n").alias("text"))


@query("""WITH a AS (SELECT item_id AS qid, 'See [' || (item_id % 4 + 2) || '] and [1, ' || (item_id % 3 + 1) || '] or [9].' AS answer FROM benchmark),
 n AS (SELECT qid, num, min(nth) AS first FROM (SELECT qid, unnest(l)::BIGINT AS num, generate_subscripts(l, 1) AS nth FROM (SELECT qid, regexp_extract_all(answer, '[0-9]+') AS l FROM a)) GROUP BY ALL)
 SELECT qid, num AS n, row_number() OVER (PARTITION BY qid ORDER BY first) AS new_n FROM n""")
def citation_render(t: Tables) -> DataFrame:
    n = F.col("item_id")
    answers = t.benchmark.select(n.alias("qid"), F.concat(F.lit("See ["), n % 4 + 2, F.lit("] and [1, "), n % 3 + 1, F.lit("] or [9].")).alias("answer"))
    return P.cited(answers).withColumn("new_n", F.col("new_n").cast("long"))


@query("""WITH a AS (SELECT item_id AS qid, text, item_id % 4 + 2 AS a, item_id % 3 + 1 AS b FROM benchmark),
 o AS (SELECT *, CASE WHEN a <= 4 THEN [a] ELSE [] END || CASE WHEN a <> 1 THEN [1] ELSE [] END || CASE WHEN b NOT IN (a, 1) THEN [b] ELSE [] END AS o FROM a),
 s AS (SELECT *, ['¹', '²', '³'] AS up FROM o)
 SELECT qid, text || CASE WHEN a <= 4 THEN up[list_position(o, a)] ELSE '' END || ' and' || up[list_position(o, 1)] || CASE WHEN b <> 1 THEN chr(8201) || up[list_position(o, b)] ELSE '' END || ' or.' AS text,
  array_to_string(o, ' ') AS cited, CASE WHEN a > 4 THEN a || ' ' ELSE '' END || '9' AS lost FROM s""")
def rendered_answers(t: Tables) -> DataFrame:
    """Whole texts as answers with markers behind; four sources are known."""
    n = F.col("item_id")
    answer = F.concat("text", F.lit(" ["), n % 4 + 2, F.lit("] and [1, "), n % 3 + 1, F.lit("] or [9]."))
    r = P.rendered(answer, F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 4)]))
    return t.benchmark.select(n.alias("qid"), r.alias("r")).select("qid", "r.text", F.array_join("r.cited", " ").alias("cited"), F.array_join("r.lost", " ").alias("lost"))


COUNTED = {k: f"len(list_filter(words, lambda w: w IN ({', '.join(repr(w) for w in ws)})))" for k, ws in E.LANGUAGE_WORDS.items()}
DECLINES = " OR ".join(f"contains(lower(answer), '{p}')" for p in E.DECLINING)


@query(f"""SELECT *, has_all AND has_none AND no_match AND right_language AND right_refusal AS passed FROM (SELECT qid, contains(answer, 'the') AND contains(answer, 'er') AS has_all, NOT contains(answer, 'qqq') AS has_none, NOT regexp_matches(answer, '[0-9]{{4}}') AND NOT regexp_matches(answer, '^x') AS no_match,
 CASE WHEN qid % 3 = 0 THEN true ELSE coalesce(CASE WHEN {COUNTED['en']} > {COUNTED['de']} THEN 'en' WHEN {COUNTED['de']} > {COUNTED['en']} THEN 'de' END = CASE qid % 3 WHEN 1 THEN 'en' ELSE 'de' END, false) END AS right_language,
 CASE WHEN qid % 2 = 0 THEN true ELSE ({DECLINES}) = (qid % 4 = 1) END AS right_refusal FROM (SELECT *, {TERMS.format('answer')} AS words FROM (SELECT item_id AS qid, text || CASE WHEN item_id % 5 = 0 THEN ' It is Not Mentioned.' ELSE '' END AS answer FROM benchmark)))""")
def eval_assertions(t: Tables) -> DataFrame:
    n = F.col("item_id")
    listed = lambda *ws: F.array(*[F.lit(w) for w in ws])
    rows = t.benchmark.select(
        n.alias("qid"), F.concat("text", F.when(n % 5 == 0, " It is Not Mentioned.").otherwise("")).alias("answer"), listed("the", "er").alias("contains"), listed("qqq").alias("not_contains"), listed("[0-9]{4}", "^x").alias("not_matches"),
        F.when(n % 3 == 1, "en").when(n % 3 == 2, "de").alias("lang"), F.when(n % 2 == 1, n % 4 == 1).alias("refusal"))
    return E.assertions(rows)
