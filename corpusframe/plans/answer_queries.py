"""Queries over evidence, conflicts, contexts and citations."""

from pyspark.sql import functions as F

from corpusframe.functions import fixed, text
from corpusframe.operators import conflicts, evidence, vector
from corpusframe.operators import context as packing
from corpusframe.plans import model_tables as m
from corpusframe.plans.model_sql import TOK, define, sql_list
from corpusframe.plans.registry import query
from corpusframe.sources.tables import read_table


def _hits(spark, d, top=5):
    """Nearest chunks with everything needed to show and cite them."""
    chunks = m.chunks(spark, d)
    asked = m.questions(spark, d)
    found = vector.semantic_search(asked, chunks, top).withColumnRenamed("rank", "number")
    return packing.attach_chunks(found, chunks, ["filename", "content", "section_path", "page_number"], asked, top)


define("hits", """
SELECT k.question_id, k.rank AS number, k.chunk_id, k.document_id, k.score, c.filename, c.content, c.section_path, c.page_number
FROM knn k JOIN chunks c USING (chunk_id) WHERE k.rank <= 5
""", ("knn", "chunks"))
IGNORED = sql_list(fixed.STOPWORDS + fixed.SCAFFOLDING)
define("asked_terms", f"""
SELECT question_id, list_distinct(list_filter({TOK.format('question')}, lambda t: len(t) > 2 AND NOT list_contains({IGNORED}, t))) AS terms FROM questions
""", ("questions",))


def overlap_sql(source: str) -> str:
    seen = TOK.format("content || ' ' || coalesce(section_path, '') || ' ' || filename")
    return f"""
SELECT a.question_id, coalesce(h.n, 0) AS hits, CASE WHEN len(a.terms) = 0 THEN 1.0 ELSE len(list_intersect(a.terms, coalesce(h.seen, []))) / len(a.terms) END AS overlap
FROM asked_terms a LEFT JOIN (SELECT question_id, count(*) AS n, flatten(list({seen})) AS seen FROM {source} GROUP BY 1) h USING (question_id)
"""


define("overlap_rows", overlap_sql("hits"), ("asked_terms", "hits"))
define("near_hits", """
SELECT k.question_id, c.filename, c.content, c.section_path FROM knn k JOIN chunks c USING (chunk_id)
WHERE k.rank <= 5 AND k.score <= 1.1 AND k.document_id <> CAST(k.question_id // 20 AS VARCHAR)
""", ("knn", "chunks"))
define("near_overlap", overlap_sql("near_hits"), ("asked_terms", "near_hits"))


@query("SELECT question_id, hits, round(overlap, 6) AS overlap FROM overlap_rows", ("overlap_rows",))
def keyword_overlap(spark, d):
    return evidence.keyword_overlap(m.questions(spark, d), _hits(spark, d)).withColumn("overlap", F.round("overlap", 6))


@query("""
SELECT question_id, hits, round(overlap, 6) AS overlap,
  CASE WHEN hits = 0 THEN 'empty' WHEN overlap < 0.2 THEN 'lexical' WHEN overlap >= 0.75 THEN 'lexical-strong' ELSE 'needs_model' END AS method,
  CASE WHEN hits = 0 OR overlap < 0.2 THEN false WHEN overlap >= 0.75 THEN true END AS sufficient
FROM near_overlap
""", ("near_overlap",))
def evidence_bands(spark, d):
    """Near hits outside the question's own book; some questions have none."""
    own = F.floor(F.col("question_id") / 20).cast("string")
    hits = vector.within_distance(_hits(spark, d), 1.1).where(F.col("document_id") != own)
    bands = evidence.evidence_band(evidence.keyword_overlap(m.questions(spark, d), hits))
    return bands.withColumn("overlap", F.round("overlap", 6))


CLAIM_SQL = rf"""
SELECT chunk_id, document_id, filename, uploaded_at, pos AS position, value,
  list_transform(list_filter(regexp_extract_all(lower(words), '[a-z]+'), lambda w: NOT list_contains({sql_list(fixed.CLAIM_FILLER)}, w))[1:4],
    lambda w: CASE WHEN len(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[1:len(w)-1] ELSE w END) AS key
FROM (SELECT *, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value, unnest(w) AS words FROM (
  SELECT chunk_id, document_id, filename, uploaded_at, regexp_extract_all(content, '(\d+(?:\.\d+)?)\s+([^.;:\n]{{0,80}})', 1) AS v,
    regexp_extract_all(content, '(\d+(?:\.\d+)?)\s+([^.;:\n]{{0,80}})', 2) AS w FROM SOURCE))
"""
define("part_claims", "SELECT * FROM (" + CLAIM_SQL.replace("SOURCE", "part_chunks") + ") WHERE len(key) >= 2", ("part_chunks",))
define("doc_claims", "SELECT * FROM (" + CLAIM_SQL.replace(
    "SOURCE", "(SELECT document_id AS chunk_id, document_id, filename, created_at AS uploaded_at, content FROM library)") + ") WHERE len(key) >= 2", ("library",))


@query("""
SELECT chunk_id, document_id, CAST(position AS INTEGER) AS position, value, array_to_string(key, ' ') AS subject FROM part_claims
UNION ALL SELECT chunk_id, document_id, CAST(position AS INTEGER), value, array_to_string(key, ' ') FROM doc_claims
""", ("part_claims", "doc_claims"))
def extract_claims(spark, d):
    """Claims of every part sentence and of every whole document."""
    docs = m.library(spark, d).select(F.col("document_id").alias("chunk_id"), "document_id", "filename", "content", F.col("created_at").alias("uploaded_at"))
    parts = m.part_chunks(spark, d).select(*docs.columns)
    return conflicts.extract_claims(parts.unionByName(docs)).select(
        "chunk_id", "document_id", "position", "value", F.array_join("key", " ").alias("subject"))


define("first_claims", """
SELECT key, document_id, arg_min(value, (chunk_id, position)) AS value, arg_min(filename, (chunk_id, position)) AS filename,
  any_value(uploaded_at) AS uploaded_at, min((chunk_id, position)) AS place FROM part_claims GROUP BY 1, 2
""", ("part_claims",))
define("conflicting", """
SELECT f.*, count(*) OVER (PARTITION BY key) AS documents, row_number() OVER (PARTITION BY key ORDER BY uploaded_at DESC NULLS LAST, place) AS n
FROM first_claims f WHERE key IN (SELECT key FROM first_claims GROUP BY key HAVING count(*) > 1 AND count(DISTINCT value) > 1)
""", ("first_claims",))


def _conflicts(spark, d):
    stamped = conflicts.stamp_upload_times(
        m.part_chunks(spark, d),
        m.part_chunks(spark, d).groupBy("document_id").agg(F.first("uploaded_at").alias("created_at")))
    return conflicts.find_conflicts(conflicts.extract_claims(stamped))


@query("""
SELECT array_to_string(key, ' ') AS subject, document_id, value, documents, n = 1 AS current,
  strftime(uploaded_at, '%Y-%m-%d') AS uploaded FROM conflicting
""", ("conflicting",))
def find_conflicts(spark, d):
    return _conflicts(spark, d).select(
        F.array_join("key", " ").alias("subject"), "document_id", "value", "documents", "current",
        F.date_format("uploaded_at", "yyyy-MM-dd").alias("uploaded"))


@query("""
SELECT subject, subject || ': ' || string_agg(says, '') FILTER (n = 1) || ' — most recent. Previously ' || string_agg(says, '; ' ORDER BY n) FILTER (n > 1) || '.' AS note
FROM (SELECT array_to_string(key, ' ') AS subject, n, filename || ' says ' || value || coalesce(' (uploaded ' || strftime(uploaded_at, '%Y-%m-%d') || ')', '') AS says FROM conflicting)
GROUP BY subject
""", ("conflicting",))
def conflict_notes(spark, d):
    """Notes need one bounded scope: one document per brand at most speaks here."""
    return conflicts.conflict_notes(_conflicts(spark, d), [])


# Every fortieth part is a source of the same question, in the order of the parts.
define("scoped_first", """
SELECT CAST(chunk_id AS BIGINT) % 40 AS question_id, key, document_id, arg_min(value, (chunk_id, position)) AS value, arg_min(filename, (chunk_id, position)) AS filename,
  any_value(uploaded_at) AS uploaded_at, min((chunk_id, position)) AS place FROM part_claims GROUP BY 1, 2, 3
""", ("part_claims",))
define("scoped_lines", """
SELECT question_id, min(place) AS raised, '- ' || subject || ': ' || string_agg(says, '') FILTER (n = 1) || ' — most recent. Previously ' || string_agg(says, '; ' ORDER BY n) FILTER (n > 1) || '.' AS line FROM (
  SELECT question_id, key, array_to_string(key, ' ') AS subject, place, filename || ' says ' || value || coalesce(' (uploaded ' || strftime(uploaded_at, '%Y-%m-%d') || ')', '') AS says,
    row_number() OVER (PARTITION BY question_id, key ORDER BY uploaded_at DESC NULLS LAST, place) AS n,
    count(*) OVER (PARTITION BY question_id, key) AS documents, min(value) OVER (PARTITION BY question_id, key) AS low, max(value) OVER (PARTITION BY question_id, key) AS high FROM scoped_first)
WHERE documents > 1 AND low <> high GROUP BY question_id, subject
""", ("scoped_first",))


@query(f"""
SELECT question_id, CAST(count(*) AS INTEGER) AS conflicts, '{fixed.CONFLICT_LEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY raised) AS note FROM scoped_lines GROUP BY 1
""", ("scoped_lines",))
def context_notes(spark, d):
    """One note per question, over the parts that are its sources."""
    part = F.col("chunk_id").cast("bigint")
    hits = m.part_chunks(spark, d).withColumn("question_id", part % 40).withColumn("number", part)
    scope = ["question_id"]
    return conflicts.context_notes(conflicts.find_conflicts(conflicts.extract_claims(hits, scope), scope), scope)


RENDERED = "'[' || number || '] ' || filename || coalesce(' | section: ' || section_path, '') || ' | page ' || page_number || chr(10) || content"
define("long_hits", """
SELECT k.question_id, k.rank AS number, k.chunk_id, c.filename, c.content, c.section_path, c.page_number FROM knn k JOIN chunks c USING (chunk_id) WHERE k.rank <= 30
""", ("knn", "chunks"))


@query(f"""
SELECT question_id, CAST(number AS INTEGER) AS number, chunk_id, CAST(used AS BIGINT) AS context_characters FROM (
  SELECT *, sum(length({RENDERED}) + 7) OVER (PARTITION BY question_id ORDER BY number) - 7 AS used FROM long_hits) WHERE number = 1 OR used <= 24472
""", ("long_hits",))
def fit_to_context(spark, d):
    return packing.fit_to_context(_hits(spark, d, 30)).select("question_id", "number", "chunk_id", "context_characters")


@query(f"""
SELECT question_id, string_agg({RENDERED}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY number) AS context FROM hits GROUP BY 1
""", ("hits",))
def render_context(spark, d):
    return packing.render_context(_hits(spark, d))


define("cited", r"""
SELECT question_id, position - 1 AS position, number FROM (
  SELECT question_id, generate_subscripts(ns, 1) AS position, unnest(ns) AS number FROM (
    SELECT question_id, list_filter(ns, lambda x, i: list_position(ns, x) = i) AS ns FROM (
      SELECT question_id, list_transform(list_filter(list_transform(string_split(array_to_string(regexp_extract_all(answer, '\[([\d\s,]+)\]', 1), ','), ','), lambda p: trim(p)),
        lambda p: regexp_matches(p, '^[0-9]+$')), lambda p: CAST(p AS BIGINT)) AS ns FROM answers)))
""", ("answers",))


@query("SELECT question_id, CAST(position AS INTEGER) AS position, number FROM cited", ("cited",))
def cited_numbers(spark, d):
    return m.answers(spark, d).select(
        "question_id", F.posexplode(text.cited_numbers(F.col("answer"))).alias("position", "number"))


# Each answer was given the five rows before it as sources, nearest first.
define("sources", """
SELECT a.conv_id * 100 + a.turn AS question_id, CAST(k AS BIGINT) AS number, b.conv_id || ':' || b.turn AS chunk_id,
  CASE WHEN b.turn % 4 = 3 THEN 'calculation' ELSE 'd' || (b.turn % 2) END AS document_id, b.text AS content
FROM conversations a CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(k) JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - k
WHERE a.role <> 'system'
""")


def _sources(spark, d):
    """The five rows before an answer; an equi-join on (conversation, turn), whatever its length."""
    rows = read_table(spark, d, "conversations")
    asked = rows.where("role <> 'system'").select(
        "conv_id", F.col("turn").alias("asked_turn"), F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("k")
    ).withColumn("turn", F.col("asked_turn") - F.col("k"))
    return rows.join(asked, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("asked_turn")).alias("question_id"), F.col("k").cast("bigint").alias("number"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        F.when(F.col("turn") % 4 == 3, "calculation").otherwise(F.concat(F.lit("d"), F.col("turn") % 2)).alias("document_id"),
        F.col("text").alias("content"),
    )


@query("""
SELECT c.question_id, CAST(c.position AS INTEGER) AS position, c.number, s.chunk_id, s.chunk_id IS NULL AS hallucinated FROM cited c LEFT JOIN sources s USING (question_id, number)
""", ("cited", "sources"))
def resolve_citations(spark, d):
    return packing.resolve_citations(m.answers(spark, d), _sources(spark, d)).select(
        "question_id", "position", "number", "chunk_id", "hallucinated")


# A calculation was worked from the two sources before it.
define("resolved", """
SELECT c.question_id, c.position, s.chunk_id, s.number, s.document_id FROM cited c JOIN sources s USING (question_id, number)
""", ("cited", "sources"))
define("derived", """
SELECT r.question_id, s.chunk_id, min((r.position, r.number - s.number)) AS place FROM resolved r JOIN sources s ON s.question_id = r.question_id AND s.number IN (r.number - 1, r.number - 2)
WHERE r.document_id = 'calculation' AND NOT EXISTS (SELECT 1 FROM resolved x WHERE x.question_id = r.question_id AND x.chunk_id = s.chunk_id) GROUP BY 1, 2
""", ("resolved", "sources"))


@query("""
SELECT question_id, chunk_id, credited, CAST(row_number() OVER (PARTITION BY question_id ORDER BY side, place) AS INTEGER) AS citation_no FROM (
  SELECT question_id, chunk_id, false AS credited, 0 AS side, (position, 0) AS place FROM resolved
  UNION ALL SELECT question_id, chunk_id, true, 1, place FROM derived)
""", ("resolved", "derived"))
def credit_derived(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("question_id").orderBy("number")
    sources = _sources(spark, d)
    before = F.array_compact(F.array(F.lag("chunk_id", 1).over(order), F.lag("chunk_id", 2).over(order)))
    worked = sources.withColumn("derived_from", before).withColumn(
        "derived_from", F.when(F.col("document_id") == "calculation", F.col("derived_from")))
    cited = packing.resolve_citations(m.answers(spark, d), worked)
    return packing.credit_derived(cited, sources)


@query(r"""
WITH numbers AS (SELECT event_id AS id, user_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events),
sums AS (SELECT id, a, b, list_distinct(list_filter(['22', CAST(b AS VARCHAR), CAST(a AS VARCHAR)], lambda n: n <> CAST(a AS VARCHAR))) AS literals FROM numbers)
SELECT id AS question_id, chunk_id FROM (SELECT s.id, s.literals, p.chunk_id, list_transform(regexp_extract_all(p.content, '[\d.]*\d'), lambda t: t) AS found
  FROM sums s JOIN part_claimed p ON p.brand = s.a % 25)
WHERE len(list_intersect(literals, found)) > 0
""".replace("WITH numbers", ", numbers", 1), ("part_claimed",))
def contributing_chunks(spark, d):
    """Sums of 22, an item and a user's number (which the question contains), over one chunk per brand."""
    item = F.get_json_object("props", "$.k")
    sums = read_table(spark, d, "events").select(
        F.col("event_id").alias("question_id"), F.col("user_id").alias("u"),
        F.concat(F.lit("22 - "), item, F.lit(" * "), "user_id").alias("expression"),
        F.concat(F.lit("I have taken "), "user_id", F.lit(" of them")).alias("question"))
    stated = m.part_chunks(spark, d).groupBy("document_id").agg(
        F.min_by("content", "chunk_id").alias("first"), F.max_by("content", "chunk_id").alias("last"))
    sources = stated.select(
        "document_id", F.substring_index("document_id", "#", -1).cast("bigint").alias("brand"),
        F.col("document_id").alias("chunk_id"), F.concat_ws(" ", "first", "last").alias("content"))
    hits = sums.join(sources, F.col("u") % 25 == F.col("brand")).select("question_id", "chunk_id", "document_id", "content")
    return packing.contributing_chunks(sums.drop("u"), hits).select("question_id", "chunk_id")


define("part_claimed", """
SELECT document_id AS chunk_id, CAST(split_part(document_id, '#', 2) AS BIGINT) AS brand, arg_min(content, chunk_id) || ' ' || arg_max(content, chunk_id) AS content
FROM part_chunks GROUP BY document_id
""", ("part_chunks",))


@query("""
SELECT question_id, chunk_id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.question_id = s.question_id AND r.chunk_id = s.chunk_id)
""", ("sources", "resolved"))
def unused_hits(spark, d):
    sources = _sources(spark, d)
    return packing.unused_hits(sources, packing.resolve_citations(m.answers(spark, d), sources)).select("question_id", "chunk_id")


@query(r"""
SELECT question_id, status, status IN ('answered', 'uncited') AS answered, status IN ('degenerate', 'uncited') AS needs_retry FROM (
  SELECT a.question_id, CASE WHEN s.n IS NULL THEN 'no_results' WHEN starts_with(upper(ltrim(answer)), 'NOT_FOUND') THEN 'not_found'
    WHEN length(regexp_replace(regexp_replace(answer, '\[([\d\s,]+)\]', '', 'g'), '[^\p{L}]', '', 'g')) < 15 THEN 'degenerate'
    WHEN c.n IS NULL THEN 'uncited' ELSE 'answered' END AS status
  FROM answers a LEFT JOIN (SELECT question_id, count(*) AS n FROM sources GROUP BY 1) s USING (question_id)
  LEFT JOIN (SELECT question_id, count(*) AS n FROM cited GROUP BY 1) c USING (question_id))
""", ("answers", "sources", "cited"))
def answer_status(spark, d):
    return packing.answer_status(m.answers(spark, d), _sources(spark, d)).select("question_id", "status", "answered", "needs_retry")
