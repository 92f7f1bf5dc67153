"""Queries over keyword, semantic and hierarchical retrieval, fusion and coverage."""

from pyspark.sql import functions as F

from corpusframe.functions import fixed
from corpusframe.operators import coverage, evidence, fusion, hierarchy, keyword, lists, reuse, routing, segments, vector
from corpusframe.operators import context as packing
from corpusframe.plans import model_tables as m
from corpusframe.plans.model_sql import ASKED, DISTANCE, TOK, bm25, define, rrf, sql_list
from corpusframe.plans.registry import query
from corpusframe.session import scratch_folder
from corpusframe.sources.tables import read_table

HIT = ["question_id", "chunk_id", "document_id", "rank"]


def _score(digits=6):
    return F.round("score", digits).alias("score")


@query("SELECT term, df, round(idf, 6) AS idf FROM bm25_idf", ("bm25_idf",))
def bm25_terms(spark, d):
    index = keyword.build_index(m.chunks(spark, d, vectors=False))
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


# The index holds every text but the French, and German ones that have gone since.
bm25("refreshed", "live_chunks", "questions")
define("live_chunks", "SELECT c.* FROM chunks c JOIN documents d USING (doc_id) WHERE d.lang <> 'de'", ("chunks",))


def _grown(spark, d):
    """A stored index before and after a refresh, and the chunks it then holds."""
    chunks = m.chunks(spark, d, vectors=False).join(
        read_table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return segments.write_index(chunks.where("lang <> 'fr'"), scratch_folder(spark)), chunks.where("lang <> 'de'")


@query("""
SELECT 'term' AS kind, term AS name, df AS n, round(idf, 6) AS idf FROM refreshed_idf
UNION ALL SELECT CASE lang WHEN 'fr' THEN 'added' ELSE 'removed' END, chunk_id, 0, 0.0 FROM chunks c JOIN documents d USING (doc_id)
  WHERE lang IN ('fr', 'de')
""", ("refreshed_idf",))
def index_delta(spark, d):
    """What a refresh changes, and the statistics after a second one, which finds nothing to do."""
    index, live = _grown(spark, d)
    changes = segments.changes(index, live).select(
        F.col("change").alias("kind"), F.col("chunk_id").alias("name"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("idf"))
    again = segments.refresh(segments.refresh(index, live), live)
    terms = again.statistics().terms.select(
        F.lit("term").alias("kind"), F.col("term").alias("name"), F.col("df").alias("n"), F.round("idf", 6).alias("idf"))
    return terms.unionByName(changes.unionByName(segments.changes(again, live).selectExpr("'left over' AS kind", "chunk_id AS name", "0L AS n", "0.0D AS idf")))


@query("SELECT question_id, chunk_id, document_id, CAST(rank AS INTEGER) AS rank, score FROM refreshed WHERE rank <= 5", ("refreshed",))
def stored_topk(spark, d):
    """Questions against a stored index of two segments, reading the blocks that each of them needs."""
    index, live = _grown(spark, d)
    return segments.search(m.questions(spark, d), segments.refresh(index, live)).select(*HIT, "score")


@query("SELECT question_id, chunk_id, document_id, CAST(rank AS INTEGER) AS rank, score FROM bm25 WHERE rank <= 5", ("bm25",))
def bm25_topk(spark, d):
    index = keyword.build_index(m.chunks(spark, d, vectors=False))
    return keyword.keyword_search(m.questions(spark, d), index).select(*HIT, "score")


define("allowed", """
SELECT question_id, CAST(unnest([question_id % 7, question_id % 11 + 5, question_id // 20]) AS VARCHAR) AS document_id FROM questions
""", ("questions",))
bm25("all_bm25", "chunks", "questions")


@query("""
SELECT side, question_id, chunk_id, document_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT 'keyword' AS side, s.question_id, s.chunk_id, s.document_id, s.score,
    row_number() OVER (PARTITION BY s.question_id ORDER BY s.score DESC, s.chunk_id) AS rank
  FROM bm25_scores s WHERE s.score > 0 AND (s.question_id % 3 = 2 OR EXISTS (SELECT 1 FROM allowed a WHERE a.question_id = s.question_id AND a.document_id = s.document_id))
  UNION ALL SELECT 'semantic', k.question_id, k.chunk_id, k.document_id, k.score, row_number() OVER (PARTITION BY k.question_id ORDER BY k.score, k.chunk_id)
  FROM knn k WHERE (k.question_id % 3 = 2 OR EXISTS (SELECT 1 FROM allowed a WHERE a.question_id = k.question_id AND a.document_id = k.document_id)))
WHERE rank <= 5
""", ("bm25_scores", "knn", "allowed"))
def scoped_search(spark, d):
    """Every question has its own scope of three books; a third of them search everything."""
    n = F.col("question_id")
    books = F.array(*[b.cast("string") for b in (n % 7, n % 11 + 5, F.floor(n / 20))])
    asked = m.questions(spark, d).withColumn("scope", F.when(n % 3 != 2, books))
    chunks = m.chunks(spark, d)
    words = keyword.keyword_search(asked, keyword.build_index(m.chunk_texts(spark, d))).select(F.lit("keyword").alias("side"), *HIT, _score())
    near = vector.semantic_search(asked, chunks).select(F.lit("semantic").alias("side"), *HIT, _score())
    return words.unionByName(near)


KNN_ALL = f"""
SELECT question_id, chunk_id, label, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT a.vec_id AS question_id, CAST(b.vec_id AS VARCHAR) AS chunk_id, b.label, {DISTANCE.format('a.embedding', 'b.embedding')} AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {DISTANCE.format('a.embedding', 'b.embedding')}, CAST(b.vec_id AS VARCHAR)) AS rank
  FROM embeddings a, embeddings b) WHERE rank <= 5
"""


@query(KNN_ALL)
def knn_topk(spark, d):
    """Every vector against every vector."""
    vecs = read_table(spark, d, "embeddings")
    asked = vecs.select(F.col("vec_id").alias("question_id"), "embedding")
    chunks = vecs.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), "embedding")
    return vector.nearest(asked, chunks).select(
        "question_id", "chunk_id", F.col("document_id").cast("int").alias("label"), "rank", _score())


def _listed(spark, d):
    vecs = read_table(spark, d, "embeddings")
    chunks = vecs.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), "embedding")
    return vecs.select(F.col("vec_id").alias("question_id"), "embedding"), lists.write_lists(chunks, scratch_folder(spark))


@query()
def knn_indexed(spark, d):
    """Every vector against the lists it reads of an inverted file over all vectors."""
    asked, index = _listed(spark, d)
    return lists.search(asked, index).select("question_id", "chunk_id", F.col("document_id").cast("int").alias("label"), "rank", _score())


@query(KNN_ALL)
def knn_certified(spark, d):
    """The same index, read on until nothing nearer can be left."""
    asked, index = _listed(spark, d)
    return lists.search(asked, index, certified=True).select(
        "question_id", "chunk_id", F.col("document_id").cast("int").alias("label"), "rank", _score())


@query("""
SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM knn WHERE rank <= 5 AND score <= 1.6
""", ("knn",))
def knn_max_distance(spark, d):
    hits = vector.nearest(m.questions(spark, d), m.chunks(spark, d))
    return vector.within_distance(hits, 1.6).select("question_id", "chunk_id", "rank", _score())


COSINE = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 9)"
define("cached", """
SELECT CAST(label AS VARCHAR) AS scope, vec_id AS entry, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS recency FROM embeddings
""")


@query(f"""
SELECT question_id, scope, entry, round(sim, 6) AS similarity FROM (
  SELECT q.question_id, c.scope, CAST(c.entry AS VARCHAR) AS entry, {COSINE.format('q.embedding', 'c.embedding')} AS sim,
    row_number() OVER (PARTITION BY q.question_id ORDER BY {COSINE.format('q.embedding', 'c.embedding')} DESC, c.recency) AS place
  FROM questions q JOIN cached c ON c.scope = CAST(q.question_id % 10 AS VARCHAR) AND c.recency <= 500) WHERE place = 1
""", ("questions", "cached"))
def cosine_best(spark, d):
    cache = _cache(spark, d)
    asked = m.questions(spark, d).withColumn("scope", (F.col("question_id") % 10).cast("string"))
    return reuse.best_match(asked, cache).select("question_id", "scope", "entry", F.round("similarity", 6).alias("similarity"))


def _cache(spark, d):
    return read_table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("scope"), F.col("vec_id").cast("string").alias("entry"),
        F.concat(F.lit("question "), "vec_id").alias("question"), "embedding",
        F.timestamp_seconds(F.col("vec_id") * 60 + m.EPOCH_2026).alias("stored_at"))


@query("""
SELECT question_id, document_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM doc_rank
""", ("doc_rank",))
def rank_documents(spark, d):
    return hierarchy.rank_documents(m.questions(spark, d), m.books(spark, d)).select(
        "question_id", "document_id", "rank", F.round("score", 4).alias("score"))


@query("""
SELECT question_id, document_id, section_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM sections
""", ("sections",))
def select_sections(spark, d):
    asked = m.questions(spark, d)
    documents = hierarchy.rank_documents(asked, m.books(spark, d))
    return hierarchy.select_sections(asked, m.chunks(spark, d), documents).select(
        "question_id", "document_id", "section_id", "rank", _score())


define("near_sections", """
SELECT question_id, document_id, section_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, place) AS r FROM (
  SELECT question_id, document_id, section_id, min(score) AS score, min(rank) AS place FROM knn WHERE rank <= 8 GROUP BY ALL)) WHERE r <= 4
""", ("knn",))


@query("""
SELECT mode, question_id, chunk_id, document_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT mode, question_id, chunk_id, document_id, score, row_number() OVER (PARTITION BY mode, question_id ORDER BY score, chunk_id) AS rank FROM (
    SELECT 'lists' AS mode, * FROM knn k WHERE EXISTS (SELECT 1 FROM near_sections s WHERE s.question_id = k.question_id AND s.document_id = k.document_id)
      AND EXISTS (SELECT 1 FROM near_sections s WHERE s.question_id = k.question_id AND s.section_id = k.section_id)
    UNION ALL SELECT 'strict', * FROM knn k WHERE EXISTS (SELECT 1 FROM near_sections s WHERE s.question_id = k.question_id AND s.document_id = k.document_id AND s.section_id = k.section_id)))
WHERE rank <= 5
""", ("near_sections",))
def retrieve_in_sections(spark, d):
    """Sections of the eight nearest chunks; both readings of the section filter."""
    asked, chunks = m.questions(spark, d), m.chunks(spark, d)
    nearest = vector.nearest(asked, chunks, 8).groupBy("question_id", "document_id", "section_id").agg(
        F.min("score").alias("score"), F.min("rank").alias("place"))
    from corpusframe.operators.scale import top_k
    sections = top_k(nearest, ["question_id"], [F.asc("score"), F.asc("place")], 4, "r")
    lists = hierarchy.retrieve_in_sections(asked, chunks, sections).select(F.lit("lists").alias("mode"), *HIT, _score())
    strict = hierarchy.retrieve_in_sections(asked, chunks, sections, strict=True).select(F.lit("strict").alias("mode"), *HIT, _score())
    return lists.unionByName(strict)


@query("""
SELECT question_id, chunk_id, document_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM tree_all WHERE rank <= 5
""", ("tree_all",))
def hierarchical(spark, d):
    return hierarchy.hierarchical_search(m.questions(spark, d), m.books(spark, d), m.chunks(spark, d)).select(*HIT, _score())


FUSED = "question_id, chunk_id, document_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, fused_score, CAST(n_sources AS INTEGER) AS n_sources, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(keyword_rank AS INTEGER) AS keyword_rank"


def _fused(df):
    return df.select(*HIT, _score(), "fused_score", F.size("sources").alias("n_sources"),
                     F.col("semantic_rank").cast("int").alias("semantic_rank"), F.col("keyword_rank").cast("int").alias("keyword_rank"))


def _lists(spark, d, wide=10):
    asked, chunks = m.questions(spark, d), m.chunks(spark, d)
    return vector.semantic_search(asked, chunks, wide), keyword.keyword_search(asked, keyword.build_index(m.chunk_texts(spark, d)), wide)


@query(f"""
SELECT {FUSED}, agreed.found_by_both FROM fused10 JOIN (SELECT question_id, count(*) FILTER (n_sources > 1) AS found_by_both FROM fused10 GROUP BY 1) agreed USING (question_id)
""", ("fused10",))
def rrf_fuse(spark, d):
    hits = fusion.rrf_fuse(*_lists(spark, d), 10)
    both = fusion.found_by_both(hits)
    return _fused(hits).join(both, "question_id")


@query(f"SELECT {FUSED} FROM reranked WHERE rank <= 5", ("reranked",))
def rerank(spark, d):
    return _fused(fusion.rerank(fusion.rrf_fuse(*_lists(spark, d), 10)))


# Keyword and hierarchical lists joined to the semantic one, as the composition does.
define("tree10", "SELECT * FROM tree_all WHERE rank <= 10", ("tree_all",))
define("dense_tree", """
SELECT question_id, chunk_id, document_id, score, rank FROM dense10
UNION ALL SELECT t.question_id, t.chunk_id, t.document_id, t.score, t.rank + coalesce(n.n, 0) FROM tree10 t
  LEFT JOIN (SELECT question_id, count(*) AS n FROM dense10 GROUP BY 1) n USING (question_id)
""", ("dense10", "tree10"))
rrf("fused_all", "dense_tree", "sparse10", ("dense_tree", "sparse10"), 10)


@query(f"""
SELECT {FUSED} FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY question_id ORDER BY fused_score DESC, n_sources DESC, coalesce(score, 1e9), rank) AS rank FROM fused_all)
WHERE rank <= 5
""", ("fused_all",))
def hybrid_search(spark, d):
    """All three retrievers fused and reranked; every question finds something on both sides."""
    return _fused(fusion.retrieve(
        m.questions(spark, d), m.chunks(spark, d), ["semantic", "keyword", "hierarchical"], m.books(spark, d),
        keyword.build_index(m.chunk_texts(spark, d))))


@query("""
SELECT 'semantic' AS mode, question_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, CAST(NULL AS DOUBLE) AS fused_score FROM knn WHERE rank <= 5
UNION ALL SELECT 'keyword', question_id, chunk_id, CAST(rank AS INTEGER), score, NULL FROM bm25 WHERE rank <= 5
UNION ALL SELECT 'hybrid', question_id, chunk_id, CAST(rank AS INTEGER), round(score, 6), fused_score FROM fused10 WHERE rank <= 5
""", ("knn", "bm25", "fused10"))
def search_view(spark, d):
    asked, chunks = m.questions(spark, d), m.chunks(spark, d)
    index = keyword.build_index(m.chunk_texts(spark, d))
    views = [
        fusion.search_view(asked, chunks, mode, index=index).select(
            F.lit(mode).alias("mode"), "question_id", "chunk_id", "rank", _score(), F.col("fused_score").cast("double").alias("fused_score"))
        for mode in ("semantic", "keyword", "hybrid")
    ]
    return views[0].unionByName(views[1]).unionByName(views[2])


define("tool_lists", """
SELECT 0 AS tool, question_id, chunk_id, document_id, rank, score, CAST(rank AS BIGINT) AS semantic_rank, CAST(NULL AS BIGINT) AS keyword_rank FROM dense10
UNION ALL SELECT 1, question_id, chunk_id, document_id, rank, score, NULL, rank FROM sparse10
UNION ALL SELECT 2, question_id, chunk_id, document_id, rank, score, semantic_rank, keyword_rank FROM fused10
""", ("dense10", "sparse10", "fused10"))


@query("""
SELECT question_id, chunk_id, document_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY f) AS INTEGER) AS rank, round(s, 6) AS fused_score,
  round(score, 6) AS score, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(keyword_rank AS INTEGER) AS keyword_rank
FROM (SELECT question_id, chunk_id, document_id, sum(1.0 / (60 + rank)) AS s, min(tool * 1000 + rank) AS f, arg_min(score, tool * 1000 + rank) AS score,
  arg_min(semantic_rank, tool * 1000 + rank) FILTER (semantic_rank IS NOT NULL) AS semantic_rank,
  arg_min(keyword_rank, tool * 1000 + rank) FILTER (keyword_rank IS NOT NULL) AS keyword_rank FROM tool_lists GROUP BY ALL)
""", ("tool_lists",))
def rrf_nway(spark, d):
    """Three tools ranked on their own: semantic, keyword and their fusion."""
    dense, sparse = _lists(spark, d)
    null = F.lit(None).cast("int")
    columns = ["question_id", "chunk_id", "document_id", "score", "rank"]
    semantic = dense.select(F.lit(0).alias("tool_no"), *columns, F.array(F.lit("semantic")).alias("sources"), F.col("rank").alias("semantic_rank"), null.alias("keyword_rank"))
    words = sparse.select(F.lit(1).alias("tool_no"), *columns, F.array(F.lit("keyword")).alias("sources"), null.alias("semantic_rank"), F.col("rank").alias("keyword_rank"))
    fused = fusion.rrf_fuse(dense, sparse, 10).select(F.lit(2).alias("tool_no"), *columns, "sources", "semantic_rank", "keyword_rank")
    merged = fusion.merge_tools(semantic.unionByName(words).unionByName(fused))
    return merged.select(*HIT, _score(), "fused_score", "semantic_rank", "keyword_rank")


def coverage_sql(source: str, budget: str, per_doc: int = 2, max_docs: int = 8) -> str:
    """Round-robin grouping of ranked candidates (question_id, chunk_id, document_id, score, rank)."""
    return f"""
SELECT question_id, chunk_id, document_id, score, rank, number, documents_matched, count(DISTINCT document_id) OVER (PARTITION BY question_id) AS documents_covered FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY turn, doc) AS number FROM (
    SELECT h.*, d.doc, d.documents_matched, row_number() OVER (PARTITION BY h.question_id, h.document_id ORDER BY h.rank) AS turn
    FROM {source} h JOIN (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY best, seen) AS doc, count(*) OVER (PARTITION BY question_id) AS documents_matched
      FROM (SELECT question_id, document_id, coalesce(min(score), 1e9) AS best, min(rank) AS seen FROM {source} GROUP BY ALL)) d
    USING (question_id, document_id) WHERE d.doc <= least({max_docs}, {budget})) WHERE turn <= {per_doc}) WHERE number <= {budget}
"""


define("dense64", "SELECT * FROM knn WHERE rank <= 64", ("knn",))
define("grouped9", coverage_sql("dense64", "9"), ("dense64",))


@query("""
SELECT question_id, chunk_id, document_id, CAST(number AS INTEGER) AS number, documents_matched, CAST(documents_covered AS INTEGER) AS documents_covered FROM grouped9
""", ("grouped9",))
def coverage_group(spark, d):
    hits = vector.semantic_search(m.questions(spark, d), m.chunks(spark, d), 64)
    return coverage.group_by_document(hits, 9).select(
        "question_id", "chunk_id", "document_id", "number", "documents_matched", "documents_covered")


def breadth_sql(prefix: str, dense: str, topical: str) -> None:
    """Coverage of a dense list and the keyword list of topic terms: ``prefix``covered and ``prefix``named."""
    bm25(f"{prefix}topic_bm25", "chunks", topical)
    define(f"{prefix}topic64", f"SELECT * FROM {prefix}topic_bm25 WHERE rank <= 64", (f"{prefix}topic_bm25",))
    define(f"{prefix}first_wins", f"""
SELECT question_id, chunk_id, document_id, arg_min(score, side * 1000 + rank) AS score, semantic_rank, keyword_rank, row_number() OVER (PARTITION BY question_id ORDER BY min(side * 1000 + rank)) AS rank
FROM (SELECT *, min(rank) FILTER (side = 1) OVER (PARTITION BY question_id, chunk_id) AS keyword_rank, min(rank) FILTER (side = 0) OVER (PARTITION BY question_id, chunk_id) AS semantic_rank FROM (
  SELECT question_id, chunk_id, document_id, score, rank, 0 AS side FROM {dense}
  UNION ALL SELECT question_id, chunk_id, document_id, score, rank, 1 FROM {prefix}topic64)) GROUP BY question_id, chunk_id, document_id, semantic_rank, keyword_rank
""", (dense, f"{prefix}topic64"))
    define(f"{prefix}named", f"""
SELECT *, bool_or(keyword_rank IS NOT NULL) OVER (PARTITION BY question_id) AS strict,
  bool_or(keyword_rank IS NOT NULL) OVER (PARTITION BY question_id, document_id) AS named FROM {prefix}first_wins
""", (f"{prefix}first_wins",))
    define(f"{prefix}qualified", f"SELECT question_id, chunk_id, document_id, score, rank FROM {prefix}named WHERE named OR NOT strict", (f"{prefix}named",))
    define(f"{prefix}covered", coverage_sql(f"{prefix}qualified", "5"), (f"{prefix}qualified",))


breadth_sql("", "dense64", "topical")


@query("""
SELECT c.question_id, c.chunk_id, c.document_id, CAST(c.number AS INTEGER) AS number, round(c.score, 6) AS score, c.documents_matched, CAST(c.documents_covered AS INTEGER) AS documents_covered,
  CAST(coalesce(x.n, 0) AS INTEGER) AS documents_excluded, greatest(least(c.documents_matched, 8) - c.documents_covered, 0) AS documents_dropped
FROM covered c LEFT JOIN (SELECT question_id, count(DISTINCT document_id) AS n FROM named WHERE strict AND NOT named GROUP BY 1) x USING (question_id)
""", ("covered", "named"))
def coverage_search(spark, d):
    hits = coverage.coverage_search(m.questions(spark, d), m.chunks(spark, d), index=keyword.build_index(m.chunk_texts(spark, d)), budget=5)
    return hits.select("question_id", "chunk_id", "document_id", "number", _score(), "documents_matched", "documents_covered",
                       "documents_excluded", "documents_dropped")


@query(r"""
WITH lines AS (SELECT g.question_id, c.filename, g.number, '[' || g.number || '] ' || CASE WHEN length(s) <= 420 THEN s WHEN length(h) - 1 > 210 THEN h ELSE rtrim(substr(s, 1, 420)) || '…' END AS line
  FROM grouped9 g JOIN (SELECT *, regexp_extract(substr(s, 1, 420), '(?s)^(.*[.?!]) ', 1) AS h FROM (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS s FROM chunks)) c USING (chunk_id)),
files AS (SELECT question_id, filename, min(number) AS first, '=== DOCUMENT: ' || filename || ' ===' || chr(10) || string_agg(line, chr(10) ORDER BY number) AS block FROM lines GROUP BY 1, 2)
SELECT question_id, count(*) AS documents, count(*) || ' document(s) are listed below.' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY first) AS context FROM files GROUP BY 1
""".replace("WITH lines", ", lines", 1), ("grouped9", "chunks"))
def grouped_context(spark, d):
    chunks = m.chunks(spark, d)
    asked = m.questions(spark, d)
    hits = coverage.group_by_document(vector.semantic_search(asked, chunks, 64), 9)
    return coverage.grouped_context(packing.attach_chunks(hits, chunks, ["filename", "content"], asked, 9))


define("carried", "SELECT question_id + 1 AS question_id, chunk_id, document_id, score, rank AS number FROM reranked WHERE rank <= 3", ("reranked",))
define("trimmed", """
SELECT 'depth' AS kind, question_id, chunk_id, document_id, rank AS number FROM reranked WHERE rank <= 5
UNION ALL SELECT 'breadth', question_id, chunk_id, document_id, number FROM breadth
""", ("reranked", "breadth"))
define("breadth_source", "SELECT question_id, chunk_id, document_id, score, rank FROM fused10", ("fused10",))
define("breadth", coverage_sql("breadth_source", "5"), ("breadth_source",))


@query("""
SELECT kind, question_id, chunk_id, document_id, CAST(row_number() OVER (PARTITION BY kind, question_id ORDER BY side, number) AS INTEGER) AS number FROM (
  SELECT 0 AS side, * FROM trimmed
  UNION ALL SELECT 1, k.kind, c.question_id, c.chunk_id, c.document_id, c.number FROM carried c, (SELECT DISTINCT kind FROM trimmed) k
  WHERE NOT EXISTS (SELECT 1 FROM trimmed t WHERE t.kind = k.kind AND t.question_id = c.question_id AND t.chunk_id = c.chunk_id))
""", ("trimmed", "carried"))
def final_context(spark, d):
    """Each question carries the previous question's three best hits."""
    hits = fusion.rrf_fuse(*_lists(spark, d), 10)
    carried = fusion.rerank(hits, 3).select(
        (F.col("question_id") + 1).alias("question_id"), "chunk_id", "document_id", "score", F.col("rank").alias("number"))
    columns = ["question_id", "chunk_id", "document_id", "number"]
    depth = packing.final_context(hits, carried).select(F.lit("depth").alias("kind"), *columns)
    breadth = packing.final_context(hits, carried, aggregated=True).select(F.lit("breadth").alias("kind"), *columns)
    return depth.unionByName(breadth)


rrf("fused_kh", "tree10", "sparse10", ("tree10", "sparse10"), 10)
define("compared", """
SELECT 'semantic' AS composition, question_id, chunk_id, document_id, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank <= 5
UNION ALL SELECT 'semantic+keyword', question_id, chunk_id, document_id, CAST(rank AS INTEGER) FROM reranked WHERE rank <= 5
UNION ALL SELECT 'keyword+hierarchical', question_id, chunk_id, document_id, CAST(rank AS INTEGER) FROM (
  SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY question_id ORDER BY fused_score DESC, n_sources DESC, coalesce(score, 1e9), rank) AS rank FROM fused_kh) WHERE rank <= 5
""", ("knn", "reranked", "fused_kh"))


@query("SELECT * FROM compared", ("compared",))
def compare_compositions(spark, d):
    arms = [["semantic"], ["keyword", "semantic"], ["hierarchical", "keyword"]]
    return fusion.compare(m.questions(spark, d), m.chunks(spark, d), arms, m.books(spark, d), index=keyword.build_index(m.chunk_texts(spark, d))).select("composition", *HIT)


# A third of the questions is about the library as a whole; questions differ from the plain ones by their words only.
define("mixed_questions", f"""
SELECT question_id, question, embedding, ({" OR ".join(f"regexp_matches(question, '(?i){p}')" for p in fixed.LIBRARY_WIDE)}) AS wide FROM (
  SELECT question_id, CASE question_id % 6 WHEN 0 THEN 'Which documents mention ' || question WHEN 3 THEN 'Compare across all files: ' || question ELSE question END AS question, embedding FROM questions)
""", ("questions",))
define("broad_questions", f"""
SELECT question_id, CASE WHEN topic <> '' THEN topic ELSE question END AS question FROM (
  SELECT question_id, question, array_to_string(list_filter({TOK.format('question')}, lambda t: len(t) > 2 AND NOT list_contains({sql_list(fixed.SCAFFOLDING)}, t)), ' ') AS topic FROM mixed_questions WHERE wide)
""", ("mixed_questions",))
define("broad_dense", "SELECT * FROM dense64 WHERE question_id IN (SELECT question_id FROM mixed_questions WHERE wide)", ("dense64", "mixed_questions"))
breadth_sql("broad_", "broad_dense", "broad_questions")


@query("""
SELECT route, question_id, chunk_id, document_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, fused_score, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(keyword_rank AS INTEGER) AS keyword_rank,
  CAST(documents_matched AS BIGINT) AS documents_matched, CAST(documents_covered AS BIGINT) AS documents_covered, CAST(documents_dropped AS BIGINT) AS documents_dropped FROM (
  SELECT 'ranked' AS route, question_id, chunk_id, document_id, rank, score, fused_score, semantic_rank, keyword_rank, NULL AS documents_matched, NULL AS documents_covered, NULL AS documents_dropped
  FROM reranked WHERE rank <= 5 AND question_id NOT IN (SELECT question_id FROM mixed_questions WHERE wide)
  UNION ALL SELECT 'coverage', c.question_id, c.chunk_id, c.document_id, c.number, c.score, NULL, n.semantic_rank, n.keyword_rank, c.documents_matched, c.documents_covered, greatest(least(c.documents_matched, 8) - c.documents_covered, 0)
  FROM broad_covered c JOIN broad_named n USING (question_id, chunk_id))
""", ("reranked", "mixed_questions", "broad_covered", "broad_named"))
def routed_search(spark, d):
    """One composition over a mixed batch; every third question is answered by coverage."""
    n = F.col("question_id") % 6
    asked = m.questions(spark, d).withColumn("question", F.when(n == 0, F.concat(F.lit("Which documents mention "), "question")).when(
        n == 3, F.concat(F.lit("Compare across all files: "), "question")).otherwise(F.col("question")))
    found = fusion.routed_search(asked, m.chunks(spark, d), ["keyword", "semantic"], index=keyword.build_index(m.chunk_texts(spark, d)))
    return found.select("route", *HIT, _score(), "fused_score", "semantic_rank", "keyword_rank", *fusion.COUNTS)


define("composition_runs", """
SELECT *, CASE WHEN documents_matched > documents_covered THEN documents_covered || ' of ' || documents_matched ELSE CAST(documents_covered AS VARCHAR) END AS covered FROM (
  SELECT *, s.c AS documents_covered, s.m AS documents_matched FROM (
    SELECT item AS question_id, mode AS composition, bool_or(answered) AS answered, CAST(sum(chat_id % 3) AS BIGINT) AS citations, CAST(sum(chat_id % 6) AS BIGINT) AS chunks,
      count(DISTINCT CASE WHEN chat_id % 3 > 0 THEN chat_id % 5 END) AS documents_cited, min(latency_ms) AS latency_ms,
      max({'c': run_id % 4, 'm': greatest(run_id % 7, run_id % 4)}) FILTER (run_id % 5 = 0) AS s FROM runs GROUP BY 1, 2))
""", ("runs",))


@query("""
SELECT r.* EXCLUDE (s), f.fastest FROM composition_runs r LEFT JOIN (
  SELECT question_id, arg_min(composition, (latency_ms, composition)) AS fastest FROM composition_runs WHERE answered GROUP BY 1) f USING (question_id)
""", ("composition_runs",))
def composition_metrics(spark, d):
    """Every fifth run covered documents; the others ranked chunks."""
    chat, run = F.col("chat_id"), F.col("run_id")
    runs = m.runs(spark, d).select(
        F.col("item").alias("question_id"), F.col("mode").alias("composition"), "answered", "latency_ms",
        (chat % 3).alias("citation_count"), (chat % 6).alias("chunk_count"),
        F.when(run % 5 == 0, run % 4).alias("documents_covered"), F.when(run % 5 == 0, run % 7).alias("documents_matched"),
        F.when(chat % 3 > 0, F.array((chat % 5).cast("string"))).otherwise(F.array().cast("array<string>")).alias("cited_files"))
    return fusion.composition_metrics(runs)


@query(f"""
SELECT event_id, CASE WHEN len(r) = 0 THEN NULL WHEN NOT agent THEN base ELSE CASE WHEN planner THEN 'agent' ELSE 'agent-direct' END ||
    CASE WHEN len(t) > 0 THEN '[' || array_to_string(t, ',') || ']' ELSE '' END || ':' || base END AS composition,
  CASE WHEN agent THEN 'agentic' WHEN len(r) = 1 THEN 'naive' ELSE 'hybrid' END AS family, array_to_string(tools, ',') AS tools
FROM (SELECT event_id, agent, planner, r, t, array_to_string(r, '+') AS base,
  list_filter(['semantic_search', 'keyword_search', 'hierarchical_search'], lambda s: list_contains(r, replace(s, '_search', '')))
  || CASE WHEN list_contains(r, 'semantic') AND list_contains(r, 'keyword') THEN ['hybrid_search'] ELSE [] END || ['aggregate_search'] || t AS tools
FROM (SELECT event_id, event_type = 'view' AS agent, user_id % 2 = 0 AS planner,
  list_filter(['semantic', 'keyword', 'hierarchical'], lambda n: (n = 'semantic' AND user_id % 3 > 0) OR (n = 'keyword' AND user_id % 5 > 1) OR (n = 'hierarchical' AND event_id % 4 = 0)) AS r,
  list_filter(['document_lookup', 'calculate', 'web_search'], lambda n: (n = 'document_lookup' AND event_id % 3 = 0) OR (n = 'web_search' AND event_id % 5 = 0)) AS t FROM events))
""")
def composition_ids(spark, d):
    """Selections in any order; nothing selected has no id."""
    user, event = F.col("user_id"), F.col("event_id")
    retrievers = F.array_compact(F.array(
        F.when(event % 4 == 0, "hierarchical"), F.when(user % 5 > 1, "keyword"), F.when(user % 3 > 0, "semantic")))
    tools = F.array_compact(F.array(F.when(event % 5 == 0, "web_search"), F.when(event % 3 == 0, "document_lookup")))
    agent = F.col("event_type") == "view"
    return read_table(spark, d, "events").select(
        "event_id", fusion.composition_id(retrievers, agent, user % 2 == 0, tools).alias("composition"),
        fusion.composition_family(retrievers, agent).alias("family"),
        F.array_join(fusion.allowed_tools(retrievers, tools), ",").alias("tools"))


@query(f"""
SELECT q.question_id, round(min(k.score), 6) AS nearest, coalesce(min(k.score) <= 1.05, false) AS on_topic
FROM (SELECT question_id FROM questions UNION ALL SELECT -1) q LEFT JOIN reachable k ON k.question_id = q.question_id GROUP BY 1
""", ("questions", "reachable"))
def on_topic(spark, d):
    """Nearest chunk outside the question's own book; one question finds nothing at all."""
    asked, chunks = m.questions(spark, d), m.chunks(spark, d)
    others = vector.nearest(asked, chunks, 20).where(
        F.col("document_id") != F.floor(F.col("question_id") / 20).cast("string"))
    hits = others.withColumn("semantic_rank", F.col("rank")).withColumn("url", F.lit(None).cast("string"))
    everyone = asked.select("question_id").unionByName(asked.agg(F.lit(-1).cast("bigint").alias("question_id")))
    return evidence.on_topic(everyone, hits).select("question_id", F.round("nearest", 6).alias("nearest"), "on_topic")


@query(f"""
SELECT question_id, attempt, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE CASE WHEN len(searches) > 0 THEN searches[1:2] ELSE allowed[1:1] END END, ',') AS tools FROM (
SELECT *, list_filter(preferred, lambda p: list_contains(allowed, p)) AS kept, list_filter(allowed, lambda a: ends_with(a, '_search')) AS searches FROM (
SELECT question_id, attempt, allowed, CASE WHEN wide THEN ['aggregate_search'] WHEN attempt > 0 AND list_contains(allowed, 'web_search') AND pending THEN ['web_search', 'hybrid_search']
  WHEN attempt > 0 THEN ['hybrid_search', 'keyword_search'] ELSE ['hybrid_search', 'hierarchical_search'] END AS preferred
FROM (SELECT question_id, length(question) // 3 % 2 AS attempt, length(question) % 3 = 0 AS pending,
  ({" OR ".join(f"regexp_matches(question, '(?i){p}')" for p in fixed.LIBRARY_WIDE)}) AS wide,
  CASE length(question) // 7 % 3 WHEN 0 THEN ['semantic_search', 'keyword_search', 'hybrid_search', 'aggregate_search', 'web_search'] WHEN 1 THEN ['keyword_search', 'aggregate_search', 'calculate']
    ELSE ['semantic_search', 'hierarchical_search', 'aggregate_search', 'web_search'] END AS allowed FROM ({ASKED}))))
""", ("prompts", "question_texts"))
def rule_plan(spark, d):
    """Every text that can be asked, real ones included."""
    asked, size = m.asked(spark, d), F.length("question")
    attempt, n = (F.floor(size / 3) % 2), F.floor(size / 7)
    lists = [["semantic_search", "keyword_search", "hybrid_search", "aggregate_search", "web_search"],
             ["keyword_search", "aggregate_search", "calculate"],
             ["semantic_search", "hierarchical_search", "aggregate_search", "web_search"]]
    arrays = [F.array(*[F.lit(t) for t in one]) for one in lists]
    allowed = F.when(n % 3 == 0, arrays[0]).when(n % 3 == 1, arrays[1]).otherwise(arrays[2])
    plan = routing.rule_plan(F.col("question"), attempt, allowed, size % 3 == 0)
    return asked.select("question_id", attempt.alias("attempt"), F.array_join(plan, ",").alias("tools"))


define("reachable", """
SELECT question_id, score, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM knn WHERE rank <= 20 AND document_id <> CAST(question_id // 20 AS VARCHAR)
""", ("knn",))
