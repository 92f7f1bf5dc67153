"""Packing a question's hits into a context, and answers back to citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import fixed, text
from corpusframe.operators import coverage, fusion
from corpusframe.operators.scale import top_k


def attach_chunks(
    hits: DataFrame, chunks: DataFrame, columns: list[str], questions: DataFrame, top: int,
    config: Config = DEFAULT,
) -> DataFrame:
    """Hits with what is needed to show them, read from the chunk table.

    There are at most ``top`` hits per question. While that product is within the bound the
    hits travel and the chunk text stays where it is; beyond it both sides shuffle.
    """
    shown = chunks.select("chunk_id", *columns)
    most = config.resident_hits // top
    if questions.limit(most + 1).count() <= most:
        return shown.join(F.broadcast(hits), "chunk_id")
    return hits.join(shown, "chunk_id")


def rendered(columns: list[str]) -> Column:
    """One numbered source: provenance header, then content."""
    def has(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("string")

    number = F.concat(F.lit("["), F.col("number"), F.lit("] "))
    url = has("url")
    head = (
        F.when(url != "", F.concat(number, F.lit("WEB: "), F.col("filename"), F.lit(" | "), url))
        .when(F.col("document_id") == "calculation", F.concat(number, F.lit("CALCULATION")))
        .otherwise(F.concat(number, F.col("filename")))
    )
    path = has("section_path")
    uploaded = F.date_format("uploaded_at", "yyyy-MM-dd") if "uploaded_at" in columns else F.lit(None).cast("string")
    header = F.concat_ws(
        " | ", head, F.concat(F.lit("uploaded "), uploaded),
        F.when(path != "", F.concat(F.lit("section: "), path)),
        F.concat(F.lit("page "), has("page_number").cast("string")),
    )
    return F.concat(header, F.lit("\n"), F.col("content"))


def allowance(config: Config = DEFAULT) -> int:
    return int(max(config.context_tokens - config.context_reserve_tokens, 512) * config.characters_per_token)


def fit_to_context(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The longest prefix by number that fits the window, and always the first hit."""
    so_far = Window.partitionBy("question_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    gap = len(fixed.CONTEXT_SEPARATOR)
    used = F.sum(F.length(rendered(hits.columns)) + gap).over(so_far) - gap
    return hits.withColumn("context_characters", used).withColumn(
        "_at", F.row_number().over(Window.partitionBy("question_id").orderBy("number"))
    ).where((F.col("_at") == 1) | (F.col("context_characters") <= allowance(config))).drop("_at")


def render_context(hits: DataFrame) -> DataFrame:
    """The context of each question: its sources in order, joined by a rule."""
    source = F.struct("number", rendered(hits.columns).alias("source"))
    return hits.groupBy("question_id").agg(
        F.array_sort(F.collect_list(source)).alias("_sources")
    ).select(
        "question_id",
        F.array_join(F.transform("_sources", lambda s: s.source), fixed.CONTEXT_SEPARATOR).alias("context"),
    )


def merge_context(
    fresh: DataFrame, carried: DataFrame, cap: int | None = None, cap_first: bool = True,
) -> DataFrame:
    """Fresh hits, then carried ones not already present, renumbered.

    A live chat caps the carried hits first and drops repeats after; ``cap_first=False``
    drops repeats first, then caps.
    """
    ids = fresh.select("question_id", "chunk_id")

    def capped(df: DataFrame) -> DataFrame:
        return df if cap is None else top_k(df, ["question_id"], [F.asc("number")], cap, "_place").drop("_place")

    extra = capped(carried) if cap_first else carried
    extra = extra.join(ids, ["question_id", "chunk_id"], "left_anti")
    extra = extra if cap_first else capped(extra)
    both = fresh.withColumn("_side", F.lit(0)).unionByName(extra.withColumn("_side", F.lit(1)))
    order = Window.partitionBy("question_id").orderBy("_side", "number")
    return both.withColumn("number", F.row_number().over(order)).drop("_side")


def final_context(
    hits: DataFrame, carried: DataFrame, top: int | None = None, aggregated: bool = False,
    config: Config = DEFAULT,
) -> DataFrame:
    """Trim by preference or by coverage, then append what the conversation carried over.

    hits(question_id, chunk_id, document_id, score, rank, fused_score, sources).
    """
    top = top or config.top_k
    columns = ["question_id", "chunk_id", "document_id", "score", "number"]
    if aggregated:
        trimmed = coverage.group_by_document(hits, top, config).select(*columns)
    else:
        trimmed = fusion.rerank(hits, top, config).withColumnRenamed("rank", "number").select(*columns)
    return merge_context(trimmed, carried.select(*columns))


def resolve_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per distinct cited number, in order of first use; unknown numbers are flagged.

    answers(question_id, answer), hits(question_id, number, chunk_id, ...).
    """
    cited = answers.select(
        "question_id", F.posexplode(text.cited_numbers(F.col("answer"))).alias("position", "number")
    )
    return cited.join(hits, ["question_id", "number"], "left").withColumn(
        "hallucinated", F.col("chunk_id").isNull()
    )


def credit_derived(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations plus the sources a cited calculation was worked from, appended once each.

    citations(question_id, position, chunk_id, derived_from), hits(question_id, chunk_id).
    """
    valid = citations.where(F.col("chunk_id").isNotNull())
    already = valid.select("question_id", "chunk_id").distinct()
    derived = (
        valid.select("question_id", "position", F.posexplode("derived_from").alias("_at", "chunk_id"))
        .groupBy("question_id", "chunk_id")
        .agg(F.min(F.struct("position", "_at")).alias("_order"))
        .join(hits.select("question_id", "chunk_id").distinct(), ["question_id", "chunk_id"], "left_semi")
        .join(already, ["question_id", "chunk_id"], "left_anti")
        .select("question_id", "chunk_id", F.lit(1).alias("_side"), "_order", F.lit(True).alias("credited"))
    )
    plain = valid.select(
        "question_id", "chunk_id", F.lit(0).alias("_side"),
        F.struct(F.col("position").alias("position"), F.lit(0).alias("_at")).alias("_order"),
        F.lit(False).alias("credited"),
    )
    order = Window.partitionBy("question_id").orderBy("_side", "_order")
    return plain.unionByName(derived).withColumn("citation_no", F.row_number().over(order)).select(
        "question_id", "citation_no", "chunk_id", "credited"
    )


def contributing_chunks(sums: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that supplied a figure of the expression which the question did not contain.

    sums(question_id, expression, question), hits(question_id, chunk_id, document_id, content).
    """
    literals = F.array_except(text.numbers_in(F.col("expression")), text.numbers_in(F.col("question")))
    needed = sums.select("question_id", literals.alias("_literals")).where(F.size("_literals") > 0)
    # One alternation per row: a figure with no digit or decimal point around it.
    inner = F.array_join(F.transform("_literals", lambda n: F.replace(n, F.lit("."), F.lit("\\."))), "|")
    pattern = F.concat(F.lit(r"(?<![\d.])(?:"), inner, F.lit(r")(?!\d|\.\d)"))
    return (
        hits.where("document_id <> 'calculation'")
        .join(needed.withColumn("_pattern", pattern), "question_id")
        .where(F.regexp_like(F.coalesce("content", F.lit("")), F.col("_pattern")))
        .drop("_pattern", "_literals")
    )


def unused_hits(hits: DataFrame, citations: DataFrame) -> DataFrame:
    cited = citations.where(F.col("chunk_id").isNotNull()).select("question_id", "chunk_id").distinct()
    return hits.join(cited, ["question_id", "chunk_id"], "left_anti")


def answer_status(answers: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """status per answer: no_results, not_found, degenerate, uncited (ask again) or answered."""
    upper = F.upper(F.ltrim("answer"))
    if hits is not None:
        counts = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_hits"))
        answers = answers.join(counts, "question_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    empty = F.col("n_hits") == 0 if "n_hits" in answers.columns else F.lit(False)
    status = (
        F.when(empty, "no_results")
        .when(upper.startswith(fixed.NOT_FOUND), "not_found")
        .when(text.is_degenerate(F.col("answer")), "degenerate")
        .when(F.size(text.cited_numbers(F.col("answer"))) == 0, "uncited")
        .otherwise("answered")
    )
    return answers.withColumn("status", status).withColumn(
        "answered", F.col("status").isin("answered", "uncited")
    ).withColumn("needs_retry", F.col("status").isin("degenerate", "uncited"))
