"""Is the retrieved text about the question?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import fixed, text


def scored_terms(question):
    ignored = text.words_in(dict.fromkeys(fixed.STOPWORDS + fixed.SCAFFOLDING))
    return F.array_distinct(F.filter(
        text.tokens(question), lambda t: ~F.array_contains(ignored, t) & (F.length(t) > 2)
    ))


def keyword_overlap(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of a question's distinct terms found in its hits; 1.0 without any term.

    hits(question_id, content[, section_path], filename). Each hit is cut to the question's
    own terms inside its row before anything is gathered.
    """
    asked = questions.select("question_id", scored_terms(F.col("question")).alias("_terms"))
    fields = [F.col(c) for c in ("content", "section_path", "filename") if c in hits.columns]
    seen = text.tokens(F.concat_ws(" ", *fields))
    found = hits.join(asked, "question_id").select(
        "question_id", F.array_intersect("_terms", seen).alias("_seen")
    )
    per_question = found.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_seen")))).alias("_found"),
    )
    total = F.size("_terms")
    return asked.join(per_question, "question_id", "left").select(
        "question_id",
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.when(total == 0, 1.0).otherwise(F.coalesce("_found", F.lit(0)) / total).alias("overlap"),
    )


def evidence_band(overlaps: DataFrame, config: Config = DEFAULT, use_model: bool = True) -> DataFrame:
    """sufficient / method per question; ``needs_model`` marks the middle band."""
    middle = "needs_model" if use_model else "lexical"
    method = (
        F.when(F.col("hits") == 0, "empty")
        .when(F.col("overlap") < config.min_overlap, "lexical")
        .when(F.col("overlap") >= config.skip_model_above, "lexical-strong")
        .otherwise(middle)
    )
    sufficient = (F.col("hits") > 0) & (F.col("overlap") >= config.min_overlap)
    if use_model:
        sufficient = F.when(method != middle, sufficient)
    return overlaps.withColumn("method", method).withColumn("sufficient", sufficient)


def on_topic(questions: DataFrame, hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Whether any distance (never a keyword score, never a web result) is near enough."""
    usable = F.col("semantic_rank").isNotNull()
    if "url" in hits.columns:
        usable = usable & F.col("url").isNull()
    nearest = hits.groupBy("question_id").agg(F.min(F.when(usable, F.col("score"))).alias("nearest"))
    return questions.select("question_id").join(nearest, "question_id", "left").withColumn(
        "on_topic", F.coalesce(F.col("nearest") <= config.max_topic_distance, F.lit(False))
    )
