"""Answer reuse: exact, then by similarity, within one scope and lifetime.

cache(scope, entry, question, embedding, stored_at, ttl_seconds); questions(question_id,
question, pipeline, top_k, scope_ids[, embedding], asked_at).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import text
from corpusframe.operators import vector
from corpusframe.operators.scale import carried_forward, numbered, top_k
from corpusframe.session import settle

UNIT = "\u001f"


def scope_digest(composition: Column, top: Column, document_ids: Column) -> Column:
    ids = F.when(F.size(document_ids) > 0, F.array_join(F.array_sort(document_ids), ",")).otherwise("*")
    return F.sha2(F.concat_ws(UNIT, composition, top.cast("string"), ids), 256)


def entry_digest(question: Column, scope: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, text.normalise_question(question), scope), 256)


def alive(stored_at: Column, ttl_seconds: Column, now: Column) -> Column:
    return now < stored_at + F.make_dt_interval(secs=ttl_seconds)


def reuse_exact(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """The newest answer stored under the entry when the question was asked, if still alive.

    questions(question_id, entry, asked_at). Storing again overwrites, so each question sees
    one answer: an as-of pass per entry, never the pairs of questions and stored versions.
    """
    stored = F.struct("stored_at", "ttl_seconds", F.col("question").alias("cached_question"))
    moments = cache.select(
        "entry", F.col("stored_at").alias("at"), F.lit(0).alias("side"), stored.alias("stored"),
        F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"),
    ).unionByName(questions.select(
        "entry", F.col("asked_at").alias("at"), F.lit(1).alias("side"),
        F.lit(None).cast(cache.select(stored.alias("s")).schema["s"].dataType).alias("stored"), "question_id",
    ))
    seen = carried_forward(
        moments.where("entry is not null"), ["entry"], ["at", "side", "question_id"], F.col("stored"), "answer"
    )
    return seen.where("side = 1 and answer is not null").where(
        alive(F.col("answer.stored_at"), F.col("answer.ttl_seconds"), F.col("at"))
    ).select("question_id", "entry", "answer.stored_at", "answer.cached_question")


def recent_candidates(cache: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The most recent entries of every scope, newest first as ``recency``."""
    return top_k(cache, ["scope"], [F.desc("stored_at"), F.asc("entry")], config.cache_candidates, "recency")


def living_candidates(questions: DataFrame, cache: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(scope, asked_at, entry, stored_at, question, embedding, recency): what every moment of asking could reuse.

    Of every entry the newest version stored by then, if still alive, and of these the most recent entries. A version
    lives from its own to the next storing of its entry, or to the end of its lifetime. Lives are cut into dyadic
    spans of time, so whatever lies in one span lives through all of it and only its most recent entries can count;
    a moment meets one span a level, never all versions of its scope.
    """
    once = top_k(cache, ["scope", "entry", "stored_at"], [F.asc("question")], 1, "_version").drop("_version")
    versions = numbered(once, ["scope", "entry"], ["stored_at"], "_n")
    following = versions.select("scope", "entry", (F.col("_n") - 1).alias("_n"), F.col("stored_at").alias("_replaced_at"))
    expires = F.col("stored_at") + F.make_dt_interval(secs=F.col("ttl_seconds"))
    lives = versions.join(following, ["scope", "entry", "_n"], "left").where(expires.isNotNull()).select(
        "scope", "entry", "stored_at", F.unix_micros("stored_at").alias("_from"),
        F.unix_micros(F.least("_replaced_at", expires)).alias("_to"))
    moments = questions.select("scope", "asked_at").where("asked_at is not null").distinct()
    span = moments.agg(F.min(F.unix_micros("asked_at")).alias("first"), F.max(F.unix_micros("asked_at")).alias("last")).first()
    first, length = span["first"] or 0, (span["last"] or 0) - (span["first"] or 0) + 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(length.bit_length() - 1))).alias("_level")
    lives = lives.select(
        "scope", "entry", "stored_at", F.greatest(F.col("_from") - first, F.lit(0)).alias("_from"),
        F.least(F.col("_to") - first, F.lit(length)).alias("_to")).where("_from < _to")
    cut = lives.select("*", levels).selectExpr(
        "scope", "entry", "stored_at", "_level",
        "shiftright(_from + shiftleft(1L, _level) - 1L, _level) AS _low", "shiftright(_to, _level) AS _high",
    ).where("_low < _high").selectExpr(
        "scope", "entry", "stored_at", "_level",
        "explode(filter(array(if(_low % 2 = 1, _low, null), if(_high % 2 = 1, _high - 1, null)), x -> x is not null)) AS _span")
    newest = [F.desc("stored_at"), F.asc("entry")]
    lists = top_k(cut, ["scope", "_level", "_span"], newest, config.cache_candidates, "_place").drop("_place")
    met = moments.select("scope", "asked_at", levels).withColumn(
        "_span", F.expr(f"shiftright(unix_micros(asked_at) - {first}L, _level)"))
    seen = met.join(lists, ["scope", "_level", "_span"]).select("scope", "asked_at", "entry", "stored_at")
    recent = top_k(seen, ["scope", "asked_at"], newest, config.cache_candidates, "recency")
    return recent.join(once.select("scope", "entry", "stored_at", "question", "embedding"), ["scope", "entry", "stored_at"])


def _most_similar(asked: DataFrame, candidates: DataFrame, config: Config) -> DataFrame:
    """asked(question_id, scope, embedding), candidates(scope, entry, embedding, recency)."""
    named = candidates.select(
        F.concat_ws(":", F.lpad(F.col("recency").cast("string"), 6, "0"), "entry").alias("chunk_id"),
        F.col("scope").alias("document_id"), "embedding",
    )
    asked = asked.select("question_id", F.array("scope").alias("scope"), "embedding")
    return vector.nearest(asked, named, 1, metric="cosine", config=config)


def best_match(questions: DataFrame, cache: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Most similar entry of the same scope and vector width per question.

    questions(question_id, scope, embedding). Equal similarities keep the newest entry.
    """
    hits = _most_similar(questions, recent_candidates(cache, config), config)
    return hits.select(
        "question_id", F.col("document_id").alias("scope"),
        F.substring_index("chunk_id", ":", -1).alias("entry"), (-F.col("score")).alias("similarity"),
    )


def reuse_similar(
    questions: DataFrame, cache: DataFrame, exact: DataFrame, config: Config = DEFAULT
) -> DataFrame:
    """Close enough answers for questions without an exact hit; a threshold of 1 turns it off.

    A question sees the cache as it was at its asked_at, see ``living_candidates``. Questions without that column
    are taken to be asked after all storing and before any end of life, with a warning.
    """
    misses = questions.join(exact.select("question_id"), "question_id", "left_anti")
    if "asked_at" in questions.columns:
        if "ttl_seconds" not in cache.columns:
            raise ValueError("questions with asked_at need a cache with ttl_seconds")
        moment = F.concat_ws(":", F.unix_micros("asked_at").cast("string"), "scope")
        candidates = settle(living_candidates(misses, cache, config).withColumn("_moment", moment))
        hits = _most_similar(
            misses.where("scope is not null and asked_at is not null").select("question_id", moment.alias("scope"), "embedding"),
            candidates.select(F.col("_moment").alias("scope"), "entry", "embedding", "recency"), config)
        best = hits.select(
            "question_id", F.col("document_id").alias("_moment"), F.substring("chunk_id", 1, 6).cast("int").alias("recency"),
            (-F.col("score")).alias("similarity"))
        named = candidates.select("_moment", "recency", "scope", "entry", F.col("question").alias("cached_question"))
        keys = ["_moment", "recency"]
    else:
        warnings.warn("questions without asked_at: answers are reused whenever they were stored and however old", stacklevel=2)
        cache = top_k(cache, ["scope", "entry"], [F.desc("stored_at"), F.asc("question")], 1, "_version").drop("_version")
        best = best_match(misses, cache, config)
        named = cache.select("scope", "entry", F.col("question").alias("cached_question"))
        keys = ["scope", "entry"]
    if config.similarity_threshold >= 1.0:
        best = best.limit(0)
    found = best.where(F.col("similarity") >= config.similarity_threshold).join(named, keys)
    return found.select("scope", "entry", "question_id", F.round("similarity", 4).alias("similarity"), "cached_question")


def ttl_of(tools_used: Column, config: Config = DEFAULT) -> Column:
    plain, web = F.lit(config.cache_ttl_seconds), F.lit(config.web_cache_ttl_seconds)
    return F.when(F.array_contains(tools_used, "web_search"), F.least(plain, web)).otherwise(plain)


def invalidate(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries stored after the last index change; any change flushes what came before."""
    last = changes.agg(F.max("changed_at").alias("at")).scalar()
    return cache.where(last.isNull() | (F.col("stored_at") > last))
