"""Listings and status of the document library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import text


def needing_attention(docs: DataFrame) -> DataFrame:
    """Failed documents, and ready ones that were never summarised."""
    return docs.where(
        (F.col("status") == "FAILED") | ((F.col("status") == "READY") & F.col("summary").isNull())
    )


def catalogue(docs: DataFrame, scope: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row: what the library holds, newest first, bounded, as a citable text."""
    ready = docs.where(F.col("status") == "READY")
    if scope:
        ready = ready.where(F.col("document_id").isin(sorted(set(scope))))
    total = ready.agg(F.count(F.lit(1)).alias("n")).scalar()
    newest = ready.orderBy(F.desc("created_at"), F.asc("document_id")).limit(config.catalogue_limit)
    summary = text.clip(F.col("summary"), config.catalogue_summary_characters)
    line = F.concat(
        F.lit("- "), F.col("filename"),
        F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.concat(F.lit(" — "), summary)).otherwise(""),
    )
    # At most catalogue_limit rows reach this aggregate.
    entry = F.struct((-F.unix_micros("created_at")).alias("age"), "document_id", line.alias("line"))
    listed = newest.agg(F.array_sort(F.collect_list(entry)).alias("_lines"), F.count(F.lit(1)).alias("shown"))
    return (
        listed.withColumn("total", total).where("shown > 0")
        .withColumn("truncated", F.col("total") > F.col("shown"))
        .withColumn("content", F.concat(
            F.lit("The document library contains "), F.col("total"), F.lit(" document(s)."),
            F.when(F.col("truncated"), F.concat(
                F.lit(" Showing the "), F.col("shown"), F.lit(" most recent:"))).otherwise(""),
            F.lit("\n"), F.array_join(F.transform("_lines", lambda r: r.line), "\n"),
        ))
        .select("total", "shown", "truncated", "content")
    )


SORTS = {
    "name": "filename", "size": "size_bytes", "modified": "created_at", "type": "kind", "status": "status",
}


def list_library(
    docs: DataFrame, needle: str = "", status: str | None = None, kind: str | None = None,
    sort: str = "name", ascending: bool = True,
) -> DataFrame:
    shown = docs.withColumn("kind", text.file_kind(F.col("filename")))
    if needle.strip():
        shown = shown.where(F.lower("filename").contains(needle.strip().lower()))
    if status is not None:
        shown = shown.where(F.col("status") == status)
    if kind is not None:
        shown = shown.where(F.col("kind") == kind)
    key = F.col(SORTS[sort])
    return shown.orderBy(key.asc() if ascending else key.desc(), F.asc("document_id"))


def library_totals(listing: DataFrame) -> DataFrame:
    return listing.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
        F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"),
    )


#: What a READY document without a summary says of itself.
MISSING_SUMMARY = "no summary: the document can be searched, but not described"


def fold_status(events: DataFrame) -> DataFrame:
    """Latest state per document from status events.

    events(document_id, at, event_id, status[, failure_kind][, error_message][, summary]). Every PROCESSING
    event is one attempt and clears the failure before it; the folds combine map-side. A document that ends up
    READY without any summary event carries a note instead of an error.
    """
    for name in ("failure_kind", "error_message"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    summary = F.col("summary") if "summary" in events.columns else F.lit("")
    order = F.struct("at", "event_id")
    started = F.col("status") == "PROCESSING"
    failed = F.col("status") == "FAILED"
    folded = events.groupBy("document_id").agg(
        F.max_by("status", order).alias("status"),
        F.sum(started.cast("int")).alias("attempts"),
        F.max(F.when(started, F.col("at"))).alias("last_attempt_at"),
        F.max(F.when(started, order)).alias("_started"),
        F.max(F.when(failed, order)).alias("_failed"),
        F.max_by(F.struct("failure_kind", "error_message"), F.when(failed, order)).alias("_why"),
        F.count(summary).alias("_summaries"),
    )
    standing = F.col("_failed").isNotNull() & (F.col("_started").isNull() | (F.col("_failed") > F.col("_started")))
    return folded.select(
        "document_id", "status", F.col("attempts").cast("bigint").alias("attempts"), "last_attempt_at",
        F.when(standing, F.col("_why.failure_kind")).alias("failure_kind"),
        F.when(standing, F.col("_why.error_message")).when(
            (F.col("status") == "READY") & (F.col("_summaries") == 0), MISSING_SUMMARY).alias("error_message"),
    )


def reprocess_candidates(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents not being processed whose stored file still exists."""
    return docs.where("status <> 'PROCESSING'").join(files.select("storage_path").distinct(), "storage_path", "left_semi")
