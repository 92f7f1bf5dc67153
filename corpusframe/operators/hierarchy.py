"""Document -> section -> chunk narrowing for a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import fixed
from corpusframe.operators import chunking, keyword, vector
from corpusframe.operators.scale import top_k
from corpusframe.session import settle


def rank_documents(
    questions: DataFrame, docs: DataFrame, config: Config = DEFAULT
) -> DataFrame:
    """Stage 1: READY documents ranked by BM25 over their profiles, zero scores included.

    docs(document_id, filename, summary, content, status). An explicit scope is kept whole.
    """
    ready = docs.where(F.col("status") == "READY")
    profiles = chunking.document_profiles(ready, config).select(
        F.col("document_id").alias("chunk_id"), "document_id", F.col("profile").alias("content")
    )
    limit = config.max_documents
    scoped = "scope" in questions.columns
    if not scoped:
        index = keyword.build_index(profiles, config)
        scores = keyword.keyword_scores(questions, index, config).select("question_id", "document_id", "score")
        return _fill(questions, ready, scores, limit)
    free = questions.where("scope is null or size(scope) = 0").drop("scope")
    bound = questions.where("size(scope) > 0")
    whole = rank_documents(free, docs, config)
    # A scope is its own corpus: statistics come from the scoped READY documents only.
    members = bound.select("question_id", F.explode(F.array_distinct("scope")).alias("document_id")).join(
        ready.select("document_id"), "document_id"
    )
    inside = _scoped_scores(bound, members, profiles, config)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "document_id")
    narrowed = inside.withColumn("rank", F.row_number().over(order))
    return whole.unionByName(narrowed.select(*whole.columns))


def _scoped_scores(bound, members, profiles, config) -> DataFrame:
    """BM25 with statistics per question over that question's scope."""
    postings = keyword.postings_of(profiles).select("term", "document_id", "tf", "dl")
    lengths = profiles.select("document_id", F.size(keyword.text.tokens(F.col("content"))).alias("length"))
    stats = (
        members.join(lengths, "document_id")
        .groupBy("question_id")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))
    )
    mine = members.join(postings, "document_id")
    idf = (
        mine.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("df"))
        .join(stats, "question_id")
        .withColumn("_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    )
    mean = idf.groupBy("question_id").agg(F.avg("_idf").alias("_mean"))
    weights = (
        idf.join(keyword.question_terms(bound), ["question_id", "term"])
        .join(mean, "question_id")
        .select("question_id", "term", "avgdl", (F.col("qtf") * F.when(
            F.col("_idf") < 0, config.bm25_epsilon * F.col("_mean")).otherwise(F.col("_idf"))).alias("weight"))
    )
    k1, b = config.bm25_k1, config.bm25_b
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = mine.join(weights, ["question_id", "term"]).groupBy("question_id", "document_id").agg(
        F.round(F.sum(F.col("weight") * gain), keyword.SCORE_DIGITS).alias("score")
    )
    return members.join(scores, ["question_id", "document_id"], "left").select(
        "question_id", "document_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def _fill(questions, ready, scores, limit) -> DataFrame:
    """Best documents per question; unmatched ones (score 0, id order) fill what is left.

    A question with fewer than ``limit`` matches has all of them in its top list, so the
    first 2 x limit ids always hold enough others. Only non-positive scores (a library
    whose terms are nearly all in over half of the documents) can push a question's
    matches beyond its top list; then the pool grows by the largest match count. Either
    way questions and documents are never paired up wholesale.
    """
    order = [F.desc("score"), F.asc("document_id")]
    ranked = top_k(scores, ["question_id"], order, limit).drop("rank")
    ranked = settle(ranked)
    tally = ranked.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("score") > 0).cast("int")).alias("_p")
    )
    short = questions.select("question_id").join(tally, "question_id", "left").where(
        F.coalesce("_p", F.lit(0)) < limit
    )
    crowded = tally.where((F.col("_n") == limit) & (F.col("_p") < limit)).select("question_id")
    known, reach = ranked, 2 * limit
    if not crowded.isEmpty():
        known = ranked.unionByName(scores.join(crowded, "question_id", "left_semi").select(*ranked.columns)).distinct()
        most = known.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
        reach = limit + most
    first_ids = ready.select("document_id").orderBy("document_id").limit(reach)
    pool = first_ids.agg(F.array_sort(F.collect_list("document_id")).alias("ids"))
    filler = (
        short.select("question_id", F.explode(pool.scalar()).alias("document_id"))
        .join(known.select("question_id", "document_id"), ["question_id", "document_id"], "left_anti")
        .withColumn("score", F.lit(0.0))
    )
    return top_k(known.select("question_id", "document_id", "score").unionByName(filler), ["question_id"], order, limit)


def select_sections(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, config: Config = DEFAULT
) -> DataFrame:
    """Stage 2: sections of the chosen documents, each worth its single nearest chunk.

    questions(question_id, embedding), documents(question_id, document_id).
    """
    chosen = documents.groupBy("question_id").agg(
        F.collect_list("document_id").alias("scope"), F.count(F.lit(1)).alias("_n")
    )
    asked = questions.drop("scope").join(chosen, "question_id").withColumn(
        "k", F.greatest(F.col("_n") * config.candidates_per_document, F.lit(config.max_sections)).cast("int")
    )
    hits = vector.nearest(asked, chunks, config=config)
    sections = hits.groupBy(
        "question_id", "document_id",
        F.coalesce("section_id", F.lit(fixed.WHOLE_DOCUMENT)).alias("section_id"),
    ).agg(F.min("score").alias("score"), F.min("rank").alias("_first"))
    return top_k(sections, ["question_id"], [F.asc("score"), F.asc("_first")], config.max_sections).drop("_first")


def retrieve_in_sections(
    questions: DataFrame, chunks: DataFrame, sections: DataFrame, top: int | None = None,
    strict: bool = False, config: Config = DEFAULT,
) -> DataFrame:
    """Stage 3: chunks whose document and whose section id are both selected.

    The two lists are independent, so a section id chosen in one document also admits
    that id in another chosen document; ``strict`` requires the exact pair.
    """
    if strict:
        def pair(doc, section):
            return F.concat_ws("\u001f", doc, F.coalesce(section, F.lit(fixed.WHOLE_DOCUMENT)))

        lists = sections.groupBy("question_id").agg(
            F.collect_set(pair(F.col("document_id"), F.col("section_id"))).alias("scope")
        )
        keyed = chunks.withColumn("document_id", pair(F.col("document_id"), F.col("section_id")))
        hits = vector.nearest(questions.drop("scope").join(lists, "question_id"), keyed, top, config=config)
        return hits.withColumn("document_id", F.substring_index("document_id", "\u001f", 1))
    named = F.when(F.col("section_id") != fixed.WHOLE_DOCUMENT, F.col("section_id"))
    lists = sections.groupBy("question_id").agg(
        F.collect_set("document_id").alias("scope"), F.collect_set(named).alias("section_scope")
    ).withColumn("section_scope", F.when(F.size("section_scope") > 0, F.col("section_scope")))
    return vector.nearest(questions.drop("scope").join(lists, "question_id"), chunks, top, config=config)


def hierarchical_search(
    questions: DataFrame, docs: DataFrame, chunks: DataFrame, top: int | None = None,
    config: Config = DEFAULT,
) -> DataFrame:
    documents = rank_documents(questions, docs, config)
    sections = select_sections(questions, chunks, documents, config)
    return retrieve_in_sections(questions, chunks, sections, top, config=config)
