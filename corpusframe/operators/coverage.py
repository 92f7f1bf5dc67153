"""Breadth-first retrieval: the best chunks of every matching document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import text
from corpusframe.operators import hierarchy, keyword, vector


def group_by_document(
    hits: DataFrame, budget: int | None = None, config: Config = DEFAULT
) -> DataFrame:
    """Spread a budget over documents: every document's first chunk before any second.

    hits(question_id, chunk_id, document_id, score, rank) in candidate order. Adds ``number``,
    ``documents_matched`` and ``documents_covered``. A document is worth its lowest score.
    """
    per_doc, max_docs = config.chunks_per_document, config.coverage_documents
    worth = hits.groupBy("question_id", "document_id").agg(
        F.coalesce(F.min("score"), F.lit(1e9)).alias("_best"), F.min("rank").alias("_seen")
    )
    by_worth = Window.partitionBy("question_id").orderBy("_best", "_seen")
    ranked = worth.withColumn("_doc", F.row_number().over(by_worth)).withColumn(
        "documents_matched", F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    )
    limit = F.lit(max_docs) if budget is None else F.lit(min(max_docs, budget))
    kept = ranked.where(F.col("_doc") <= limit).select("question_id", "document_id", "_doc", "documents_matched")
    inside = Window.partitionBy("question_id", "document_id").orderBy("rank")
    turns = (
        hits.join(kept, ["question_id", "document_id"])
        .withColumn("_turn", F.row_number().over(inside))
        .where(F.col("_turn") <= per_doc)
    )
    dealt = turns.withColumn(
        "number", F.row_number().over(Window.partitionBy("question_id").orderBy("_turn", "_doc"))
    )
    if budget is not None:
        dealt = dealt.where(F.col("number") <= budget)
    covered = F.size(F.collect_set("document_id").over(Window.partitionBy("question_id")))
    return dealt.withColumn("documents_covered", covered).drop("_turn", "_doc")


def first_wins(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Dense rows in order, then keyword-only rows; a shared chunk keeps its dense row."""
    columns = ["question_id", "chunk_id", "document_id", "score", "rank"]
    both = dense.select(*columns, F.lit(0).alias("_side")).unionByName(
        sparse.select(*columns, F.lit(1).alias("_side"))
    )
    place = F.struct("_side", "rank")
    is_keyword = F.col("_side") == 1
    merged = both.groupBy("question_id", "chunk_id", "document_id").agg(
        F.min_by("score", place).alias("score"), F.min(place).alias("_place"),
        F.min(F.when(~is_keyword, F.col("rank"))).alias("semantic_rank"),
        F.min(F.when(is_keyword, F.col("rank"))).alias("keyword_rank"),
    )
    order = Window.partitionBy("question_id").orderBy("_place")
    return merged.withColumn("rank", F.row_number().over(order)).drop("_place")


COLUMNS = ["question_id", "chunk_id", "document_id", "score", "rank"]


def candidate_lists(
    questions: DataFrame, chunks: DataFrame, retrievers, docs: DataFrame | None = None,
    index: keyword.KeywordIndex | None = None, config: Config = DEFAULT,
) -> dict[str, DataFrame]:
    """The wide list of each retriever; keyword retrieval runs on the topic terms."""
    wide = config.coverage_documents * config.chunks_per_document * 4
    lists = {}
    if "semantic" in retrievers:
        lists["semantic"] = vector.semantic_search(questions, chunks, wide, config).select(*COLUMNS)
    if "hierarchical" in retrievers:
        lists["hierarchical"] = hierarchy.hierarchical_search(questions, docs, chunks, wide, config).select(*COLUMNS)
    if "keyword" in retrievers:
        topical = questions.withColumn("_topic", F.array_join(text.topic_terms(F.col("question")), " "))
        topical = topical.withColumn(
            "_topic", F.when(F.col("_topic") != "", F.col("_topic")).otherwise(F.col("question"))
        )
        lists["keyword"] = keyword.keyword_search(
            topical, index or keyword.build_index(chunks, config), wide, config, question="_topic"
        ).select(*COLUMNS)
    return lists


def cover(lists: dict[str, DataFrame], budget: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """Spread the budget over the documents that the lists of ``candidate_lists`` qualify."""
    dense, sparse = lists.get("semantic"), lists.get("keyword")
    none = next(iter(lists.values())).limit(0)
    if "hierarchical" in lists:
        sizes = (none if dense is None else dense).groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"))
        after = lists["hierarchical"].join(sizes, "question_id", "left").withColumn(
            "rank", F.col("rank") + F.coalesce("_n", F.lit(0)).cast("int")
        ).select(*COLUMNS)
        dense = after if dense is None else dense.unionByName(after)
    merged = first_wins(none if dense is None else dense, none if sparse is None else sparse)
    mine = Window.partitionBy("question_id")
    same_document = Window.partitionBy("question_id", "document_id")
    named = (F.max(F.col("keyword_rank").isNotNull()).over(same_document))
    marked = merged.withColumn("_named", named).withColumn(
        "_any", F.max(F.col("keyword_rank").isNotNull()).over(mine)
    )
    strict = F.col("_any") & F.lit(config.require_keyword_match)
    outside = F.size(F.collect_set(F.when(strict & ~F.col("_named"), F.col("document_id"))).over(mine))
    kept = marked.withColumn("documents_excluded", outside).where(~strict | F.col("_named")).drop("_named", "_any")
    grouped = group_by_document(kept, budget, config)
    return grouped.withColumn(
        "documents_dropped",
        F.greatest(
            F.least("documents_matched", F.lit(config.coverage_documents)) - F.col("documents_covered"), F.lit(0)
        ),
    )


def coverage_search(
    questions: DataFrame, chunks: DataFrame, retrievers=("semantic", "keyword"), docs: DataFrame | None = None,
    index: keyword.KeywordIndex | None = None, budget: int | None = None, config: Config = DEFAULT,
) -> DataFrame:
    """Best chunks of each matching document per question, within the budget.

    Keyword retrieval runs on the topic terms; where it finds anything, it decides which
    documents qualify. Adds documents_matched, documents_covered, documents_excluded and
    documents_dropped.
    """
    return cover(candidate_lists(questions, chunks, retrievers, docs, index, config), budget, config)


def grouped_context(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Sources under their document: hits(question_id, number, filename, content)."""
    line = F.concat(F.lit("["), F.col("number"), F.lit("] "), text.excerpt(F.col("content"), config.excerpt_characters))
    per_file = hits.groupBy("question_id", "filename").agg(
        F.min("number").alias("_first"),
        F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("_lines"),
    )
    block = F.concat(
        F.lit("=== DOCUMENT: "), F.col("filename"), F.lit(" ===\n"),
        F.array_join(F.transform("_lines", lambda r: r.line), "\n"),
    )
    return per_file.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.array_sort(F.collect_list(F.struct("_first", block.alias("block")))).alias("_blocks"),
    ).select(
        "question_id", "documents",
        F.concat(
            F.col("documents"), F.lit(" document(s) are listed below.\n\n"),
            F.array_join(F.transform("_blocks", lambda b: b.block), "\n\n"),
        ).alias("context"),
    )
