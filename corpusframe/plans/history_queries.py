"""Queries over conversations, run history, the library and answer reuse."""

from pyspark.sql import functions as F

from corpusframe.operators import context as packing
from corpusframe.operators import history, library, reuse
from corpusframe.plans import model_tables as m
from corpusframe.plans.model_sql import define
from corpusframe.plans.registry import query
from corpusframe.session import scratch_folder
from corpusframe.sources.tables import append_runs, read_runs, read_table

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _at(column):
    return F.date_format(column, STAMP)


def _sql_at(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


@query("SELECT run_id, chat_id, turn_index FROM turned", ("turned",))
def assign_turns(spark, d):
    return history.assign_turns(m.runs(spark, d)).select("run_id", "chat_id", "turn_index")


@query("""
SELECT run_id, chat_id, CAST(place AS INTEGER) AS place, array_to_string(list_sort(list_distinct([f1, f2])), ', ') AS documents FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn_index DESC) AS place FROM turns) WHERE place <= 4
""", ("turns",))
def recent_turns(spark, d):
    return history.recent_turns(m.turns(spark, d)).select("run_id", "chat_id", "place", F.array_join("documents", ", ").alias("documents"))


@query(r"""
SELECT chat_id, regexp_replace(string_agg('Q: ' || question || chr(10) || 'A: ' || CASE WHEN a = '' THEN '(no answer)' ELSE a END || chr(10) || 'Documents used: ' || docs, chr(10) || chr(10) ORDER BY turn_index), '^\s+|\s+$', '', 'g') AS history
FROM (SELECT *, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substr(s, 1, 240)) || '…' END AS a FROM (
  SELECT *, trim(regexp_replace(coalesce(answer, ''), '\s+', ' ', 'g')) AS s, array_to_string(list_sort(list_distinct([f1, f2])), ', ') AS docs,
    row_number() OVER (PARTITION BY chat_id ORDER BY turn_index DESC) AS place FROM turns) WHERE place <= 4) GROUP BY chat_id
""", ("turns",))
def render_history(spark, d):
    return history.render_history(m.turns(spark, d))


@query("""
SELECT chat_id, arg_max(run_id, (answered, turn_index)) AS run_id, arg_max(turn_index, (answered, turn_index)) AS turn_index, bool_or(answered) AS answered FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn_index DESC) AS place FROM turned) WHERE place <= 20 GROUP BY 1
""", ("turned",))
def pick_reusable(spark, d):
    return history.pick_reusable(history.assign_turns(m.runs(spark, d)))


@query("""
SELECT run_id, turn_index, coalesce(last_value(CASE WHEN answered THEN run_id END IGNORE NULLS) OVER w, lag(run_id) OVER (PARTITION BY chat_id ORDER BY turn_index)) AS reusable_run_id
FROM turned WINDOW w AS (PARTITION BY chat_id ORDER BY turn_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
""", ("turned",))
def previous_answered(spark, d):
    return history.previous_answered(history.assign_turns(m.runs(spark, d))).select("run_id", "turn_index", "reusable_run_id")


define("reused", """
SELECT run_id, chat_id, coalesce(last_value(CASE WHEN answered THEN run_id END IGNORE NULLS) OVER w, lag(run_id) OVER (PARTITION BY chat_id ORDER BY turn_index)) AS reused_run_id
FROM turns WINDOW w AS (PARTITION BY chat_id ORDER BY turn_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
""", ("turns",))


@query("""
SELECT r.run_id, r.reused_run_id, CAST(k AS INTEGER) AS number, b.conv_id || ':' || b.turn AS chunk_id, b.conv_id % 7 || '-' || b.role AS document_id, k % 2 = 1 AND k <= b.turn % 4 AS was_cited
FROM reused r JOIN turns t ON t.run_id = r.reused_run_id CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(k) JOIN conversations b ON b.conv_id = t.chat_id AND b.turn = t.turn_index - k
""", ("reused", "turns"))
def carried_chunks(spark, d):
    """Turns stored with the five rows before them as their results, read back as what the next turn carries over."""
    runs = m.turns(spark, d).withColumn(
        "created_at", F.timestamp_seconds(m.EPOCH_2026 + F.col("chat_id") * 3600 + F.col("turn_index") * 60)).drop("filenames")
    back = runs.select("run_id", F.col("chat_id").alias("conv_id"), "turn_index", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("number"))
    hits = back.withColumn("turn", F.col("turn_index") - F.col("number")).join(
        read_table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")), ["conv_id", "turn"]).select(
        "run_id", "number", F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.concat_ws("-", F.col("conv_id") % 7, "role").alias("document_id"),
        "content", (F.col("number") % 2 == 1).alias("odd"), "turn")
    cited = hits.where("odd and number <= turn % 4").select("run_id", "number")
    path = scratch_folder(spark)
    append_runs(history.with_results(runs, hits, cited), path)
    return history.carried_chunks(read_runs(spark, path)).select(
        "run_id", "reused_run_id", "number", "chunk_id", "document_id", "was_cited")


define("fresh_items", "SELECT chat_id AS question_id, CAST(item AS VARCHAR) AS chunk_id, min(turn_index) AS number FROM turned WHERE mode = 'naive' GROUP BY 1, 2", ("turned",))
define("old_items", "SELECT chat_id AS question_id, CAST(item AS VARCHAR) AS chunk_id, min(turn_index) AS number FROM turned WHERE mode = 'hybrid' GROUP BY 1, 2", ("turned",))


@query("""
SELECT rule, question_id, chunk_id, CAST(row_number() OVER (PARTITION BY rule, question_id ORDER BY side, number) AS INTEGER) AS number FROM (
  SELECT r.rule, 0 AS side, f.* FROM fresh_items f, (VALUES ('cap first'), ('cap last')) r(rule)
  UNION ALL SELECT 'cap first', 1, question_id, chunk_id, number FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY number) AS p FROM old_items) o
    WHERE p <= 3 AND NOT EXISTS (SELECT 1 FROM fresh_items f WHERE f.question_id = o.question_id AND f.chunk_id = o.chunk_id)
  UNION ALL SELECT 'cap last', 1, question_id, chunk_id, number FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY number) AS p FROM old_items o
    WHERE NOT EXISTS (SELECT 1 FROM fresh_items f WHERE f.question_id = o.question_id AND f.chunk_id = o.chunk_id)) WHERE p <= 3)
""", ("fresh_items", "old_items"))
def merge_context(spark, d):
    """Items of a chat's naive runs are fresh, those of its hybrid runs are carried."""
    turned = history.assign_turns(m.runs(spark, d))

    def items(mode):
        return turned.where(F.col("mode") == mode).groupBy(
            F.col("chat_id").alias("question_id"), F.col("item").cast("string").alias("chunk_id")
        ).agg(F.min("turn_index").alias("number"))

    def merged(first):
        out = packing.merge_context(items("naive"), items("hybrid"), 3, cap_first=first)
        return out.select(F.lit("cap first" if first else "cap last").alias("rule"), "question_id", "chunk_id", "number")

    return merged(True).unionByName(merged(False))


@query("""
SELECT run_id, mode, answered, (SELECT count(*) FROM runs WHERE mode = 'naive' AND answered) AS total FROM runs
WHERE mode = 'naive' AND answered ORDER BY created_at DESC, run_id LIMIT 50 OFFSET 100
""", ("runs",))
def list_runs(spark, d):
    return history.list_runs(m.runs(spark, d), "naive", True, 50, 100).select("run_id", "mode", "answered", "total")


@query("SELECT run_id, chat_id FROM runs ORDER BY created_at DESC, run_id LIMIT 500", ("runs",))
def retain_runs(spark, d):
    return history.retain_runs(m.runs(spark, d)).select("run_id", "chat_id")


# Every customer may chat; the orders are the runs of those who did.
define("order_runs", "SELECT o_orderkey AS run_id, o_custkey AS chat_id, o_orderdate AS created_at FROM orders")


def _customers(spark, d):
    chats = read_table(spark, d, "customer").select(F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("title"), "c_acctbal")
    runs = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("chat_id"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    return chats, runs


@query(f"""
SELECT chat_id, title, turn_count, count(*) OVER () AS total, {_sql_at('updated_at')} AS updated_at FROM (
  SELECT c_custkey AS chat_id, c_name AS title, count(*) AS turn_count, max(created_at) AS updated_at FROM customer JOIN order_runs ON chat_id = c_custkey GROUP BY 1, 2)
QUALIFY row_number() OVER (ORDER BY updated_at DESC, chat_id) BETWEEN 11 AND 60
""".replace("count(*) OVER () AS total", "(SELECT count(DISTINCT chat_id) FROM order_runs JOIN customer ON c_custkey = chat_id) AS total"), ("order_runs",))
def list_chats(spark, d):
    chats, runs = _customers(spark, d)
    dated = chats.join(runs.groupBy("chat_id").agg(F.max("created_at").alias("updated_at")), "chat_id", "left")
    return history.list_chats(dated, runs, 50, 10).select("chat_id", "title", "turn_count", "total", _at("updated_at").alias("updated_at"))


@query("SELECT c_custkey AS chat_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def empty_chats(spark, d):
    chats, runs = _customers(spark, d)
    return history.empty_chats(chats, runs.where("o_totalprice > 400000")).select("chat_id")


@query(f"""
SELECT t.chat_id, t.turn_index, t.run_id, CASE WHEN length(q) <= 80 THEN q ELSE rtrim(substr(q, 1, 80)) || '…' END AS title, {_sql_at('u')} AS chat_updated_at
FROM turned t JOIN (SELECT chat_id, regexp_replace(arg_min(question, (created_at, run_id)), '\\s+', ' ', 'g') AS q, max(created_at) AS u FROM runs GROUP BY 1) c USING (chat_id)
""", ("turned",))
def chat_turns(spark, d):
    runs = m.runs(spark, d)
    return history.chat_turns(history.chats_from_runs(runs), history.assign_turns(runs)).select(
        "chat_id", "turn_index", "run_id", "title", _at("chat_updated_at").alias("chat_updated_at"))


define("doomed", "SELECT run_id FROM order_runs JOIN orders ON o_orderkey = run_id WHERE o_orderpriority <> '5-LOW'", ("order_runs",))


@query("""
SELECT 'runs' AS kind, run_id AS id FROM order_runs WHERE run_id NOT IN (SELECT run_id FROM doomed)
UNION ALL SELECT 'chats', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT chat_id FROM order_runs)
  OR c_custkey IN (SELECT chat_id FROM order_runs WHERE run_id NOT IN (SELECT run_id FROM doomed))
UNION ALL SELECT 'runs of kept chats', run_id FROM order_runs WHERE chat_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'chunks of kept documents', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
""", ("doomed", "order_runs"))
def cascade_delete(spark, d):
    """Delete all but the low-priority runs; separately, chats (and documents) of customers in debt."""
    chats, runs = _customers(spark, d)
    doomed = read_table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("run_id"))
    left_chats, left_runs = history.delete_runs(chats, runs, doomed)
    debt = chats.where("c_acctbal < 0")
    _, kept = history.delete_chats(chats, runs, debt)
    docs = chats.withColumnRenamed("chat_id", "document_id")
    chunks = runs.withColumnRenamed("chat_id", "document_id")
    _, kept_chunks = history.delete_documents(docs, chunks, docs.where("c_acctbal < 0"))

    def part(df, kind, column):
        return df.select(F.lit(kind).alias("kind"), F.col(column).alias("id"))

    return part(left_runs, "runs", "run_id").unionByName(part(left_chats, "chats", "chat_id")).unionByName(
        part(kept, "runs of kept chats", "run_id")).unionByName(part(kept_chunks, "chunks of kept documents", "run_id"))


@query("SELECT document_id, status FROM library WHERE status = 'FAILED' OR (status = 'READY' AND summary IS NULL)", ("library",))
def needing_attention(spark, d):
    return library.needing_attention(m.library(spark, d)).select("document_id", "status")


@query(r"""
SELECT total, count(*) AS shown, total > count(*) AS truncated, 'The document library contains ' || total || ' document(s). Showing the ' || count(*) || ' most recent:' || chr(10) ||
  string_agg('- ' || filename || CASE WHEN coalesce(summary, '') <> '' THEN ' — ' || CASE WHEN length(s) <= 140 THEN s ELSE rtrim(substr(s, 1, 140)) || '…' END ELSE '' END, chr(10) ORDER BY created_at DESC, document_id) AS content
FROM (SELECT *, trim(regexp_replace(summary, '\s+', ' ', 'g')) AS s FROM library WHERE status = 'READY' ORDER BY created_at DESC, document_id LIMIT 50),
  (SELECT count(*) AS total FROM library WHERE status = 'READY') GROUP BY total
""", ("library",))
def catalogue(spark, d):
    return library.catalogue(m.library(spark, d))


@query("""
WITH shown AS (SELECT document_id, filename, size_bytes, CASE split_part(filename, '.', 2) WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'DOCX' WHEN 'txt' THEN 'Text' ELSE 'Markdown' END AS kind, n_chars % 7 AS chunk_count
  FROM library JOIN documents USING (doc_id) WHERE status = 'READY' AND contains(lower(filename), 'c_1'))
SELECT document_id, filename, size_bytes, kind, CAST(NULL AS BIGINT) AS chunks, CAST(NULL AS BIGINT) AS documents FROM shown
UNION ALL SELECT 'total', NULL, CAST(sum(size_bytes) AS BIGINT), (SELECT string_agg(kind, ', ' ORDER BY kind) FROM (SELECT DISTINCT kind FROM shown)), CAST(sum(chunk_count) AS BIGINT), count(*) FROM shown
""".replace("WITH shown", ", shown", 1), ("library",))
def list_library(spark, d):
    docs = m.library(spark, d).join(read_table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 7).alias("chunk_count")), "doc_id")
    shown = library.list_library(docs, "C_1", status="READY", sort="size", ascending=False)
    null = F.lit(None).cast("bigint")
    rows = shown.select("document_id", "filename", "size_bytes", "kind", null.alias("chunks"), null.alias("documents"))
    totals = library.library_totals(shown).select(
        F.lit("total").alias("document_id"), F.lit(None).cast("string").alias("filename"), F.col("bytes").alias("size_bytes"),
        F.col("kinds").alias("kind"), "chunks", "documents")
    return rows.unionByName(totals)


define("status_events", """
SELECT user_id AS document_id, ts AS moment, event_id, CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'click' THEN 'PROCESSING' WHEN 'error' THEN 'FAILED' ELSE 'READY' END AS status,
  CASE WHEN event_type = 'error' THEN CASE WHEN value > 20 THEN 'provider' ELSE 'parse' END END AS failure_kind,
  CASE WHEN event_type = 'error' THEN 'error ' || props END AS error_message, CASE WHEN user_id % 3 > 0 AND event_type = 'view' THEN 'about ' || event_id END AS summary FROM events
""")


def _status_events(spark, d):
    kind = F.col("event_type")
    return read_table(spark, d, "events").select(
        F.col("user_id").alias("document_id"), F.col("ts").alias("at"), "event_id",
        F.when(kind == "signup", "UPLOADED").when(kind == "click", "PROCESSING").when(kind == "error", "FAILED").otherwise("READY").alias("status"),
        F.when(kind == "error", F.when(F.col("value") > 20, "provider").otherwise("parse")).alias("failure_kind"),
        F.when(kind == "error", F.concat(F.lit("error "), "props")).alias("error_message"),
        F.when((F.col("user_id") % 3 > 0) & (kind == "view"), F.concat(F.lit("about "), "event_id")).alias("summary"))


@query(f"""
SELECT document_id, arg_max(status, (moment, event_id)) AS status, count(*) FILTER (status = 'PROCESSING') AS attempts, {_sql_at("max(moment) FILTER (status = 'PROCESSING')")} AS last_attempt_at,
  CASE WHEN max((moment, event_id)) FILTER (status = 'FAILED') > coalesce(max((moment, event_id)) FILTER (status = 'PROCESSING'), (TIMESTAMP '1970-01-01', CAST(0 AS BIGINT)))
    THEN arg_max(failure_kind, (moment, event_id)) FILTER (status = 'FAILED') END AS failure_kind,
  CASE WHEN max((moment, event_id)) FILTER (status = 'FAILED') > coalesce(max((moment, event_id)) FILTER (status = 'PROCESSING'), (TIMESTAMP '1970-01-01', CAST(0 AS BIGINT)))
    THEN arg_max(error_message, (moment, event_id)) FILTER (status = 'FAILED')
    WHEN arg_max(status, (moment, event_id)) = 'READY' AND count(summary) = 0 THEN '{library.MISSING_SUMMARY}' END AS error_message
FROM status_events GROUP BY 1
""", ("status_events",))
def latest_status(spark, d):
    return library.fold_status(_status_events(spark, d)).withColumn("last_attempt_at", _at("last_attempt_at"))


@query("SELECT document_id, status FROM library WHERE status <> 'PROCESSING' AND doc_id IN (SELECT vec_id FROM embeddings)", ("library",))
def reprocess_candidates(spark, d):
    """Only documents with a paired vector still have their stored file."""
    docs = m.library(spark, d)
    files = docs.join(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").select("storage_path")
    return library.reprocess_candidates(docs, files).select("document_id", "status")


define("versions", """
SELECT CASE n_nationkey WHEN 0 THEN 'answer_generation' WHEN 1 THEN 'retrieval_planner' WHEN 2 THEN 'evidence_validation' ELSE 'prompt_' || n_nationkey END AS prompt, n_regionkey AS version FROM nation
""")


@query("""
SELECT r.run_id, v.prompt, v.version FROM runs r JOIN versions v ON CASE r.mode WHEN 'naive' THEN v.prompt = 'answer_generation' WHEN 'hybrid' THEN v.prompt = 'answer_generation'
  WHEN 'agentic' THEN v.prompt IN ('answer_generation', 'retrieval_planner', 'evidence_validation') ELSE true END
""", ("runs", "versions"))
def prompt_attribution(spark, d):
    """nation stands in for the settings table of prompt versions."""
    key = F.col("n_nationkey")
    versions = read_table(spark, d, "nation").select(
        F.when(key == 0, "answer_generation").when(key == 1, "retrieval_planner").when(key == 2, "evidence_validation")
        .otherwise(F.concat(F.lit("prompt_"), key)).alias("prompt"), F.col("n_regionkey").alias("version"))
    return history.prompt_attribution(m.runs(spark, d), versions)


DIGEST = "sha256(mode || chr(31) || CAST(chat_id % 4 AS VARCHAR) || chr(31) || CASE WHEN chat_id % 3 = 0 THEN '*' ELSE 'a' || (chat_id % 5) || ',b' || (chat_id % 7) END)"
define("digests", f"""
SELECT *, sha256(lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) || chr(31) || scope) AS entry FROM (SELECT *, {DIGEST} AS scope FROM runs)
""", ("runs",))


def _digested(spark, d):
    chat = F.col("chat_id")
    ids = F.when(chat % 3 > 0, F.array(F.concat(F.lit("b"), chat % 7), F.concat(F.lit("a"), chat % 5)))
    scoped = m.runs(spark, d).withColumn("scope", reuse.scope_digest(F.col("mode"), chat % 4, ids))
    return scoped.withColumn("entry", reuse.entry_digest(F.col("question"), F.col("scope")))


@query("SELECT run_id, scope, entry FROM digests", ("digests",))
def cache_digests(spark, d):
    return _digested(spark, d).select("run_id", "scope", "entry")


@query(f"""
SELECT run_id AS question_id, {_sql_at('stored.created_at')} AS stored_at, stored.question AS cached_question
FROM (SELECT run_id, created_at, last_value(CASE WHEN answered THEN {{'created_at': created_at, 'question': question, 'item': item}} END IGNORE NULLS) OVER (
  PARTITION BY entry ORDER BY created_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM digests)
WHERE created_at - INTERVAL 1 MICROSECOND < stored.created_at + to_seconds(86400 * (1 + stored.item % 5))
""", ("digests",))
def cache_exact(spark, d):
    """Earlier answered runs are the cache; each run asks just before its own time."""
    runs = _digested(spark, d)
    cache = runs.where("answered").select(
        "entry", "question", F.col("created_at").alias("stored_at"), (F.lit(86400) * (1 + F.col("item") % 5)).alias("ttl_seconds"))
    asked = runs.select(F.col("run_id").alias("question_id"), "entry", (F.col("created_at") - F.expr("interval 1 microsecond")).alias("asked_at"))
    return reuse.reuse_exact(asked, cache).select("question_id", _at("stored_at").alias("stored_at"), "cached_question")


COSINE = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 9)"


@query(f"""
SELECT question_id, scope, entry, cached_question, round(sim, 4) AS similarity FROM (
  SELECT q.vec_id AS question_id, CAST(q.label AS VARCHAR) AS scope, CAST(c.vec_id AS VARCHAR) AS entry, 'question ' || c.vec_id AS cached_question, {COSINE.format('q.embedding', 'c.embedding')} AS sim,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE.format('q.embedding', 'c.embedding')} DESC, c.recency) AS place
  FROM embeddings q JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS recency FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)) c
    ON c.label = q.label AND c.recency <= 500 WHERE q.vec_id NOT IN (SELECT item_id FROM benchmark)) WHERE place = 1 AND sim >= 0.3
""")
def cache_similar(spark, d):
    """Vectors ask within their label; those of labelled documents are cached, benchmark items are exact hits."""
    from corpusframe.config import Config

    vecs = read_table(spark, d, "embeddings")
    items = read_table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    # All ask a minute after the last possible storing, a minute before anything expires.
    newest = vecs.agg(F.max("vec_id").alias("newest")).scalar()
    asked = vecs.select(F.col("vec_id").alias("question_id"), F.col("label").cast("string").alias("scope"), "embedding",
                        F.timestamp_seconds((newest + 1) * 60 + m.EPOCH_2026).alias("asked_at"))
    labelled = read_table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")).distinct()
    cache = vecs.join(labelled, "vec_id", "left_semi").select(
        F.col("label").cast("string").alias("scope"), F.col("vec_id").cast("string").alias("entry"),
        F.concat(F.lit("question "), "vec_id").alias("question"), "embedding",
        F.timestamp_seconds(F.col("vec_id") * 60 + m.EPOCH_2026).alias("stored_at"), (F.lit(60) * (F.lit(2) + newest - F.col("vec_id"))).alias("ttl_seconds"))
    return reuse.reuse_similar(asked, cache, items, Config(similarity_threshold=0.3))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(3600 AS INTEGER) ELSE 86400 END AS ttl_seconds FROM events")
def cache_ttl(spark, d):
    web = F.col("event_type").isin("view", "click")
    tools = F.when(web, F.array(F.lit("keyword_search"), F.lit("web_search"))).when(F.col("event_type") == "error", F.array(F.lit("calculate")))
    return read_table(spark, d, "events").select("event_id", reuse.ttl_of(tools).alias("ttl_seconds"))


@query("""
SELECT run_id, entry FROM digests WHERE answered AND created_at > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND value > 40)
""", ("digests",))
def cache_invalidate(spark, d):
    """Large sign-ups changed the index; only what was answered after the last one stands."""
    cache = _digested(spark, d).where("answered").select("run_id", "entry", F.col("created_at").alias("stored_at"))
    changes = read_table(spark, d, "events").where("event_type = 'signup' and value > 40").select(F.col("ts").alias("changed_at"))
    return reuse.invalidate(cache, changes).select("run_id", "entry")


@query(f"""
SELECT mode, {_sql_at("date_trunc('day', created_at)")} AS day, count(*) AS runs, round(avg(answered::INTEGER), 6) AS answered_share, round(avg(latency_ms), 6) AS latency_avg, max(latency_ms) AS latency_max
FROM runs GROUP BY 1, 2
""", ("runs",))
def run_metrics_window(spark, d):
    metrics = history.run_metrics(m.runs(spark, d))
    return metrics.select("mode", _at("window.start").alias("day"), "runs", F.round("answered_share", 6).alias("answered_share"),
                          F.round("latency_avg", 6).alias("latency_avg"), "latency_max")
