"""Rank fusion and the retrieval compositions built on it.

Ranked lists are (question_id, chunk_id, document_id, score, rank); every group here is
one question's candidates, a small multiple of top_k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import fixed, text
from corpusframe.operators import coverage, hierarchy, keyword, vector
from corpusframe.operators.scale import top_k
from corpusframe.session import settle

LIST = ["question_id", "chunk_id", "document_id", "score", "rank"]
#: The order in which lists are combined, and what coverage counts.
COMBINED = ["semantic", "hierarchical", "keyword"]
COUNTS = ["documents_matched", "documents_covered", "documents_dropped"]


def rrf_fuse(
    dense: DataFrame, sparse: DataFrame, top: int | None = None, k: int | None = None,
    config: Config = DEFAULT,
) -> DataFrame:
    """Reciprocal rank fusion of a distance-ranked and a keyword-ranked list.

    Ties keep insertion order: dense rows by rank, then sparse-only rows by rank. The
    distance wins as the displayed score; a chunk listed twice on the dense side counts
    twice and shows its later rank.
    """
    k = k or config.rrf_k
    both = dense.select(*LIST, F.lit(True).alias("_dense")).unionByName(
        sparse.select(*LIST, F.lit(False).alias("_dense"))
    )
    by_dense, by_sparse = F.col("_dense"), ~F.col("_dense")
    fused = both.groupBy("question_id", "chunk_id", "document_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("_fused"),
        F.max(F.when(by_dense, F.col("rank"))).alias("semantic_rank"),
        F.max(F.when(by_sparse, F.col("rank"))).alias("keyword_rank"),
        F.min(F.when(by_dense, F.col("rank"))).alias("_first"),
        F.max_by(F.when(by_dense, F.col("score")), F.when(by_dense, F.col("rank"))).alias("_distance"),
        F.max_by(F.when(by_sparse, F.col("score")), F.when(by_sparse, F.col("rank"))).alias("_bm25"),
    )
    named = fused.withColumn("fused_score", F.round("_fused", 6)).withColumn(
        "sources", F.array_compact(F.array(
            F.when(F.col("semantic_rank").isNotNull(), "semantic"),
            F.when(F.col("keyword_rank").isNotNull(), "keyword"),
        ))
    ).withColumn(
        "score", F.when(F.col("semantic_rank").isNotNull(), F.col("_distance")).otherwise(F.col("_bm25"))
    )
    order = [
        F.desc("_fused"), F.asc(F.col("semantic_rank").isNull()),
        F.asc(F.coalesce("_first", "keyword_rank")), F.asc("chunk_id"),
    ]
    return top_k(named, ["question_id"], order, top or config.top_k).select(
        *LIST, "fused_score", "sources", "semantic_rank", "keyword_rank"
    )


def found_by_both(hits: DataFrame) -> DataFrame:
    return hits.groupBy("question_id").agg(
        F.sum((F.size("sources") > 1).cast("int")).alias("found_by_both")
    )


def preference(position: str = "rank") -> list[Column]:
    """Fused score, then agreement, then raw score, then the order given."""
    return [
        F.desc(F.coalesce("fused_score", F.lit(0.0))), F.desc(F.size("sources")),
        F.asc(F.coalesce("score", F.lit(1e9))), F.asc(position),
    ]


def rerank(hits: DataFrame, top: int | None = None, config: Config = DEFAULT) -> DataFrame:
    ordered = hits.withColumnRenamed("rank", "_given")
    return top_k(ordered, ["question_id"], preference("_given"), top or config.top_k).drop("_given")


def candidates_for(retrievers, top: int) -> int:
    return max(2 * top, 8) if len(retrievers) > 1 else top


def ordered_retrievers(retrievers) -> list[str]:
    unknown = set(retrievers) - set(fixed.RETRIEVERS)
    if not retrievers or unknown:
        raise ValueError(f"invalid retrievers: {sorted(unknown) or 'none given'}")
    return [name for name in fixed.RETRIEVERS if name in retrievers]


def combine(semantic: DataFrame | None, hierarchical: DataFrame | None, sparse: DataFrame | None,
            candidates: int, top: int, config: Config = DEFAULT) -> DataFrame:
    """Fuse per question where both sides found something, else keep the one side as it is."""
    parts = []
    if semantic is not None:
        parts.append(semantic.select(*LIST, F.lit("semantic").alias("source"), F.lit(0).alias("_list")))
    if hierarchical is not None:
        parts.append(hierarchical.select(*LIST, F.lit("hierarchical").alias("source"), F.lit(1).alias("_list")))
    if sparse is not None:
        parts.append(sparse.select(*LIST, F.lit("keyword").alias("source"), F.lit(2).alias("_list")))
    mine = Window.partitionBy("question_id")
    is_dense = F.col("_list") < 2
    lists = (
        reduce(DataFrame.unionByName, parts)
        .withColumn("_n_semantic", F.sum((F.col("_list") == 0).cast("int")).over(mine))
        .withColumn("_n_dense", F.sum(is_dense.cast("int")).over(mine))
        .withColumn("_n_sparse", F.sum((~is_dense).cast("int")).over(mine))
        # Hierarchical rows continue the dense list after the semantic ones.
        .withColumn("_position", (F.col("rank") + F.when(F.col("_list") == 1, F.col("_n_semantic")).otherwise(0)).cast("int"))
    )
    own_rank = F.when(is_dense, F.col("rank"))
    single = lists.where("_n_dense = 0 or _n_sparse = 0").select(
        "question_id", "chunk_id", "document_id", "score", F.col("_position").alias("rank"),
        F.lit(None).cast("double").alias("fused_score"), F.array("source").alias("sources"),
        own_rank.alias("semantic_rank"), F.when(~is_dense, F.col("rank")).alias("keyword_rank"),
    ).where(F.col("rank") <= top)
    if sparse is None or len(parts) == 1:
        return single
    mixed = lists.where("_n_dense > 0 and _n_sparse > 0").withColumn("rank", F.col("_position"))
    fused = rrf_fuse(mixed.where(is_dense), mixed.where(~is_dense), candidates, config=config)
    return rerank(fused, top, config).unionByName(single)


def ranked_lists(
    questions: DataFrame, chunks: DataFrame, names: list[str], wide: int, docs: DataFrame | None = None,
    index: keyword.KeywordIndex | None = None, config: Config = DEFAULT,
) -> dict[str, DataFrame]:
    """Each retriever's own list, ``wide`` rows per question."""
    lists = {}
    if "semantic" in names:
        lists["semantic"] = vector.semantic_search(questions, chunks, wide, config).select(*LIST)
    if "hierarchical" in names:
        lists["hierarchical"] = hierarchy.hierarchical_search(questions, docs, chunks, wide, config).select(*LIST)
    if "keyword" in names:
        index = index or keyword.build_index(chunks, config)
        lists["keyword"] = keyword.keyword_search(questions, index, wide, config).select(*LIST)
    return lists


def retrieve(
    questions: DataFrame, chunks: DataFrame, retrievers, docs: DataFrame | None = None,
    index: keyword.KeywordIndex | None = None, top: int | None = None, config: Config = DEFAULT,
) -> DataFrame:
    """Run a composition's retrievers over a batch of questions and combine the lists."""
    top = top or config.top_k
    names = ordered_retrievers(retrievers)
    wide = candidates_for(names, top)
    lists = ranked_lists(questions, chunks, names, wide, docs, index, config)
    return combine(*[lists.get(n) for n in COMBINED], wide, top, config)


def routed_search(
    questions: DataFrame, chunks: DataFrame, retrievers, docs: DataFrame | None = None,
    index: keyword.KeywordIndex | None = None, top: int | None = None, config: Config = DEFAULT,
) -> DataFrame:
    """A composition over a mixed batch: questions about the library as a whole are answered by coverage.

    Every question takes one way, told in ``route`` (ranked or coverage), whichever retrievers were
    chosen; ``top`` is the budget of chunks on both. A null question is ranked. documents_matched,
    documents_covered and documents_dropped are null on the ranked way.
    """
    return _routed(questions, chunks, [ordered_retrievers(retrievers)], docs, index, top, config).drop("composition")


def _routed(questions, chunks, arms, docs, index, top, config, keep=lambda df: df) -> DataFrame:
    """Every arm over both ways; each retriever's list is made once, as wide as the widest arm needs, and cut per arm."""
    top = top or config.top_k
    names = [n for n in fixed.RETRIEVERS if any(n in arm for arm in arms)]
    if "keyword" in names:
        index = index or keyword.build_index(chunks, config)
    wide_scope = F.coalesce(text.is_library_wide(F.col("question")), F.lit(False))
    broad, narrow = questions.where(wide_scope), questions.where(~wide_scope)
    widest = max(candidates_for(arm, top) for arm in arms)
    ranked = {n: keep(df) for n, df in ranked_lists(narrow, chunks, names, widest, docs, index, config).items()}
    spread = {n: keep(df) for n, df in coverage.candidate_lists(broad, chunks, names, docs, index, config).items()}
    parts = []
    for arm in arms:
        label, wide = F.lit("+".join(arm)).alias("composition"), candidates_for(arm, top)
        own = [ranked[n].where(F.col("rank") <= wide) if n in arm else None for n in COMBINED]
        parts.append(combine(*own, wide, top, config).select(
            label, F.lit("ranked").alias("route"), *LIST, "fused_score", "sources", "semantic_rank", "keyword_rank",
            *[F.lit(None).cast("long").alias(c) for c in COUNTS]))
        found = coverage.cover({n: spread[n] for n in arm}, top, config)
        dense = F.when(F.col("semantic_rank").isNotNull(), "semantic" if "semantic" in arm else "hierarchical")
        parts.append(found.select(
            label, F.lit("coverage").alias("route"), "question_id", "chunk_id", "document_id", "score",
            F.col("number").alias("rank"), F.lit(None).cast("double").alias("fused_score"),
            F.array_compact(F.array(dense, F.when(F.col("keyword_rank").isNotNull(), "keyword"))).alias("sources"),
            "semantic_rank", "keyword_rank", *[F.col(c).cast("long").alias(c) for c in COUNTS]))
    return reduce(DataFrame.unionByName, parts)


def search_view(
    questions: DataFrame, chunks: DataFrame, mode: str = "hybrid", top: int | None = None,
    index: keyword.KeywordIndex | None = None, config: Config = DEFAULT,
) -> DataFrame:
    """Retrieval as inspected: one list as it is, or both fused without a rerank."""
    top = top or config.top_k
    if mode == "hybrid":
        wide = max(2 * top, 8)
        dense = vector.semantic_search(questions, chunks, wide, config)
        sparse = keyword.keyword_search(questions, index or keyword.build_index(chunks, config), wide, config)
        return rrf_fuse(dense, sparse, top, config=config)
    if mode == "semantic":
        return combine(vector.semantic_search(questions, chunks, top, config), None, None, top, top, config)
    return combine(
        None, None, keyword.keyword_search(questions, index or keyword.build_index(chunks, config), top, config),
        top, top, config,
    )


def merge_tools(lists: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """n-way fusion: lists(tool_no, rank, ...) each ranked on its own; first copy is kept.

    Rows keep the order in which a chunk was first collected, as ``rank``.
    """
    first = F.struct("tool_no", "rank")
    merged = lists.groupBy("question_id", "chunk_id", "document_id").agg(
        F.round(F.sum(1.0 / (config.rrf_k + F.col("rank"))), 6).alias("fused_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.min_by("score", first).alias("score"),
        F.min_by("semantic_rank", F.when(F.col("semantic_rank").isNotNull(), first)).alias("semantic_rank"),
        F.min_by("keyword_rank", F.when(F.col("keyword_rank").isNotNull(), first)).alias("keyword_rank"),
        F.min(first).alias("_first"),
    )
    order = Window.partitionBy("question_id").orderBy("_first")
    return merged.withColumn("rank", F.row_number().over(order)).drop("_first")


def compare(
    questions: DataFrame, chunks: DataFrame, compositions: list, docs: DataFrame | None = None,
    top: int | None = None, config: Config = DEFAULT, index: keyword.KeywordIndex | None = None,
) -> DataFrame:
    """The same questions through two to six compositions, keyed by composition id.

    A question about the library as a whole is answered by coverage in every arm (see ``routed_search``).
    """
    if not 2 <= len(compositions) <= 6:
        raise ValueError("compare takes two to six compositions")
    arms = [ordered_retrievers(names) for names in compositions]
    return _routed(questions, chunks, arms, docs, index, top, config, settle)


def composition_metrics(runs: DataFrame) -> DataFrame:
    """Per question and composition: answered, citations, chunks, files cited, latency; fastest answered.

    runs(question_id, composition, answered, latency_ms, cited_files, chunk_count, citation_count
    [, documents_covered, documents_matched]). The last two are null on runs that ranked chunks; where
    they are given, the run that covered most tells documents_covered, documents_matched (never below
    what was covered) and ``covered`` as it is shown: "3 of 7", or "3" where nothing was left out.
    """
    keys = ["question_id", "composition"]
    measures = [
        F.max("answered").alias("answered"), F.sum("citation_count").alias("citations"),
        F.sum("chunk_count").alias("chunks"), F.min("latency_ms").alias("latency_ms"),
    ]
    counted = {"documents_covered", "documents_matched"} <= set(runs.columns)
    if counted:
        spread = F.when(F.col("documents_covered").isNotNull(), F.struct(
            F.col("documents_covered").alias("covered"),
            F.greatest("documents_matched", "documents_covered").alias("matched")))
        measures.append(F.max(spread).alias("_spread"))
    per_run = runs.groupBy(*keys).agg(*measures)
    if counted:
        few, all_of = F.col("_spread.covered"), F.col("_spread.matched")
        shown = F.when(all_of > few, F.concat(few, F.lit(" of "), all_of)).otherwise(few.cast("string"))
        per_run = per_run.select(
            "*", few.alias("documents_covered"), all_of.alias("documents_matched"), shown.alias("covered")).drop("_spread")
    files = runs.select(*keys, F.explode("cited_files").alias("file")).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents_cited")
    )
    per_run = per_run.join(files, keys, "left").withColumn("documents_cited", F.coalesce("documents_cited", F.lit(0)))
    fastest = per_run.where("answered").groupBy("question_id").agg(
        F.min_by("composition", F.struct("latency_ms", "composition")).alias("fastest")
    )
    return per_run.join(fastest, "question_id", "left")


def composition_id(retrievers: Column, agent: Column, planner: Column, tools: Column) -> Column:
    """Canonical slug; equivalent selections share it. Null where nothing is selected or unknown."""
    known = F.array(*[F.lit(n) for n in fixed.RETRIEVERS])
    extras = F.array(*[F.lit(n) for n in fixed.EXTRA_TOOLS])
    ordered, chosen = F.array_intersect(known, retrievers), F.array_intersect(extras, tools)
    valid = (F.size(ordered) > 0) & (F.size(F.array_except(retrievers, known)) == 0) & (
        F.size(F.array_except(tools, extras)) == 0
    )
    base = F.array_join(ordered, "+")
    prefix = F.when(planner, "agent").otherwise("agent-direct")
    listed = F.when(F.size(chosen) > 0, F.concat(F.lit("["), F.array_join(chosen, ","), F.lit("]"))).otherwise("")
    return F.when(valid, F.when(agent, F.concat(prefix, listed, F.lit(":"), base)).otherwise(base))


def composition_family(retrievers: Column, agent: Column) -> Column:
    known = F.array(*[F.lit(n) for n in fixed.RETRIEVERS])
    return F.when(agent, "agentic").when(F.size(F.array_intersect(known, retrievers)) == 1, "naive").otherwise("hybrid")


def allowed_tools(retrievers: Column, tools: Column) -> Column:
    """What an agent over these retrievers may choose from, in offer order."""
    has = {name: F.array_contains(retrievers, name) for name in fixed.RETRIEVERS}
    extras = F.array(*[F.lit(n) for n in fixed.EXTRA_TOOLS])
    offered = F.array(
        *[F.when(has[name], f"{name}_search") for name in fixed.RETRIEVERS],
        F.when(has["semantic"] & has["keyword"], "hybrid_search"), F.lit("aggregate_search"),
    )
    return F.concat(F.array_compact(offered), F.array_intersect(extras, tools))
