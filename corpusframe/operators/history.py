"""Conversations and run history.

runs(run_id, chat_id, question, answer, answered, mode, created_at, ...). One chat may
hold any share of the runs, so whole-chat numbering goes through time buckets and
look-back goes through overlapping blocks; only bounded tops use a plain window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import fixed, text
from corpusframe.operators.scale import numbered, top_k, with_halo
from corpusframe.schemas import RESULT

HALO_BLOCK = 10_000


def assign_turns(runs: DataFrame) -> DataFrame:
    """turn_index: the number of earlier runs in the same chat."""
    return numbered(runs, ["chat_id"], ["created_at", "run_id"], "_n").withColumn(
        "turn_index", (F.col("_n") - 1).cast("bigint")).drop("_n")


def chats_from_runs(runs: DataFrame) -> DataFrame:
    """Title from the first question, times from the first and latest run; combined map-side."""
    first = F.struct("created_at", "run_id")
    return runs.groupBy("chat_id").agg(
        F.min_by("question", first).alias("_question"), F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("turn_count"),
    ).select("chat_id", text.clip_title(F.col("_question")).alias("title"), "created_at", "updated_at", "turn_count")


def recent_turns(runs: DataFrame, turns: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """The last turns of every chat; ``place`` 1 is the newest. Files used are sorted and distinct."""
    last = top_k(runs, ["chat_id"], [F.desc("turn_index")], turns or config.history_turns, "place")
    if "filenames" in runs.columns:
        last = last.withColumn("documents", F.array_sort(F.array_distinct("filenames")))
    return last


def render_history(runs: DataFrame, turns: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """Q / A / Documents used, oldest first, answers clipped."""
    last = recent_turns(runs, turns, config)
    answer = text.clip(F.col("answer"), 240)
    used = F.lit("")
    if "documents" in last.columns:
        used = F.when(
            F.size("documents") > 0, F.concat(F.lit("\nDocuments used: "), F.array_join("documents", ", "))
        ).otherwise("")
    block = F.concat(
        F.lit("Q: "), F.col("question"), F.lit("\nA: "),
        F.when(answer == "", "(no answer)").otherwise(answer), used,
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn_index", block.alias("block"))))
    return last.groupBy("chat_id").agg(
        text.strip(F.array_join(F.transform(ordered, lambda t: t.block), "\n\n")).alias("history")
    )


def pick_reusable(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per chat the newest answered of the last runs, else the newest."""
    last = top_k(runs, ["chat_id"], [F.desc("turn_index")], config.reuse_lookback, "place")
    best = F.struct(F.coalesce("answered", F.lit(False)), "turn_index")
    return last.groupBy("chat_id").agg(
        F.max_by("run_id", best).alias("run_id"), F.max_by("turn_index", best).alias("turn_index"),
        F.max_by("answered", best).alias("answered"),
    )


def previous_answered(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """For every turn, the run a follow-up would reuse (null on a first turn)."""
    back = config.reuse_lookback
    blocks = with_halo(runs, "turn_index", back, HALO_BLOCK)
    order = Window.partitionBy("chat_id", "_block").orderBy("turn_index")
    frame = order.rowsBetween(-back, -1)
    answered = F.last(F.when(F.col("answered"), F.col("run_id")), ignorenulls=True).over(frame)
    return (
        blocks.withColumn("reusable_run_id", F.coalesce(answered, F.lag("run_id").over(order)))
        .where("not _halo")
        .drop("_block", "_halo")
    )


def with_results(runs: DataFrame, hits: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """Runs with what they showed: ``results`` in order of number, ``cited`` the numbers of the answer.

    hits(run_id, number, chunk_id, ...), bounded per run by what a question retrieves; fields of a result that the
    hits lack are null. A run that found nothing has an empty array. cited(run_id, number).
    """
    fields = T.StructType.fromDDL(f"r {RESULT}")["r"].dataType.fields
    shown = F.struct(*[
        (F.col(f.name) if f.name in hits.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    none = F.array().cast(f"array<{RESULT}>")
    results = hits.groupBy("run_id").agg(F.array_sort(F.collect_list(shown)).alias("results"))
    stored = runs.drop("results", "cited").join(results, "run_id", "left").withColumn("results", F.coalesce("results", none))
    if cited is None:
        return stored.withColumn("cited", F.array().cast("array<int>"))
    numbers = cited.groupBy("run_id").agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("cited"))
    return stored.join(numbers, "run_id", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<int>")))


def stored_results(runs: DataFrame, fields: list[str], run_ids: DataFrame | None = None) -> DataFrame:
    """One row per stored result: run_id, its ``fields`` and whether the answer cited it.

    Only the fields asked for are read from the nested column. ``run_ids``: only these runs are opened.
    """
    wanted = list(dict.fromkeys(["number", *fields]))
    parts = runs.select("run_id", "cited", F.arrays_zip(*[F.col(f"results.{f}").alias(f) for f in wanted]).alias("_rows"))
    if run_ids is not None:
        parts = parts.join(run_ids.select("run_id").distinct(), "run_id", "left_semi")
    rows = parts.select("run_id", "cited", F.explode("_rows").alias("_row"))
    return rows.select(
        "run_id", *[F.col(f"_row.{f}").alias(f) for f in wanted],
        F.coalesce(F.array_contains("cited", F.col("_row.number")), F.lit(False)).alias("was_cited"))


def carried_chunks(runs: DataFrame, fields: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """For every turn, the stored results of the run that a follow-up reuses: run_id, reused_run_id, fields.

    runs(run_id, chat_id, turn_index, answered, results, cited). The look-back reads no result; first turns have
    no row, nor have turns whose reused run found nothing.
    """
    places = previous_answered(runs.select("run_id", "chat_id", "turn_index", "answered"), config)
    pairs = places.select("run_id", F.col("reusable_run_id").alias("reused_run_id")).where("reused_run_id is not null")
    results = stored_results(runs, fields or ["chunk_id", "document_id"]).withColumnRenamed("run_id", "reused_run_id")
    return pairs.join(results, "reused_run_id")


def list_runs(
    runs: DataFrame, mode: str | None = None, answered: bool | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of runs, newest first, with the total of the filtered set."""
    if mode is not None:
        runs = runs.where(F.col("mode") == mode)
    if answered is not None:
        runs = runs.where(F.col("answered") == answered)
    total = runs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        runs.orderBy(F.desc("created_at"), F.asc("run_id")).offset(offset).limit(limit).withColumn("total", total)
    )


def retain_runs(runs: DataFrame, keep: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """The newest runs only; a global top-n, not a one-partition window."""
    return runs.orderBy(F.desc("created_at"), F.asc("run_id")).limit(keep or config.retain_runs)


def list_chats(chats: DataFrame, runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Chats with at least one turn, most recently active first, with their turn count."""
    counts = runs.groupBy("chat_id").agg(F.count(F.lit(1)).alias("turn_count"))
    shown = chats.drop("turn_count").join(counts, "chat_id")
    total = shown.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        shown.orderBy(F.desc("updated_at"), F.asc("chat_id")).offset(offset).limit(limit).withColumn("total", total)
    )


def empty_chats(chats: DataFrame, runs: DataFrame) -> DataFrame:
    return chats.join(runs.select("chat_id").distinct(), "chat_id", "left_anti")


def chat_turns(chats: DataFrame, runs: DataFrame) -> DataFrame:
    """Every turn beside its chat; one row per turn, so no chat is gathered."""
    named = chats.select("chat_id", "title", F.col("updated_at").alias("chat_updated_at"))
    return runs.join(named, "chat_id")


def delete_runs(chats: DataFrame, runs: DataFrame, run_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surviving (chats, runs): a chat that loses its last run goes as well."""
    left = runs.join(run_ids.select("run_id"), "run_id", "left_anti")
    touched = runs.join(run_ids.select("run_id"), "run_id", "left_semi").select("chat_id").distinct()
    emptied = touched.join(left.select("chat_id").distinct(), "chat_id", "left_anti")
    return chats.join(emptied, "chat_id", "left_anti"), left


def delete_chats(chats: DataFrame, runs: DataFrame, chat_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = chat_ids.select("chat_id")
    return chats.join(ids, "chat_id", "left_anti"), runs.join(ids, "chat_id", "left_anti")


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = ids.select("document_id")
    return docs.join(ids, "document_id", "left_anti"), chunks.join(ids, "document_id", "left_anti")


def prompt_attribution(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """(run_id, prompt, version) of the prompts a run's mode invokes.

    versions(prompt, version) is a settings table of a few dozen rows. An unknown mode uses all.
    """
    named = {mode: F.array(*[F.lit(p) for p in prompts]) for mode, prompts in fixed.PROMPTS_BY_MODE.items()}
    everything = versions.agg(F.array_sort(F.collect_set("prompt")).alias("p")).scalar()
    prompts = everything
    for mode, names in named.items():
        prompts = F.when(F.col("mode") == mode, names).otherwise(prompts)
    return runs.select("run_id", F.explode(prompts).alias("prompt")).join(versions, "prompt", "left")


def run_metrics(runs: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Runs, answered share and latency percentiles per mode and time window (batch or stream)."""
    span = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return runs.groupBy(span.alias("window"), "mode").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(F.col("answered").cast("double")).alias("answered_share"),
        F.avg("latency_ms").alias("latency_avg"),
        F.max("latency_ms").alias("latency_max"),
        F.percentile_approx("latency_ms", [0.5, 0.95], 10_000).alias("latency_percentiles"),
    )
