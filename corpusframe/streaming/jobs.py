"""Continuous forms: ingestion, status, answer reuse and run metrics."""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe import schemas
from corpusframe.config import DEFAULT, Config
from corpusframe.operators import chunking, history, ingest, library, reuse, structure
from corpusframe.session import settle
from corpusframe.sources import tables


OUTCOMES = "path string, document_id string, status string, reason string, failure_kind string"


def ingest_batch(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Described files to chunks: gates, blocks, sections, chunks with pages. document_id = content hash."""
    accepted = ingest.gate_files(files, config).where("reject_reason is null and content is not null")
    docs = ingest.content_hashes(accepted).withColumn("document_id", F.col("content_sha256"))
    first = docs.groupBy("document_id").agg(
        F.min_by(F.struct("filename", "content", "mime"), "path").alias("kept")
    ).select("document_id", "kept.*")
    # Parsed once; sections, tree and spans all read the blocks.
    blocks = settle(ingest.parsed_blocks(first))
    sections = structure.section_text(blocks)
    tree = structure.section_tree(blocks).select(
        "document_id", "section_no", "section_id", F.col("title").alias("section_title"),
        F.array_join("path", " > ").alias("section_path"), "parent_section_id",
    )
    chunks = chunking.chunk_sections(sections, config=config)
    spans = chunking.block_spans(structure.section_blocks(blocks))
    pages = chunking.chunk_pages(chunks, spans).select("document_id", "section_no", "chunk_index", "page_number")
    return (
        chunks.join(pages, ["document_id", "section_no", "chunk_index"], "left")
        .join(tree, ["document_id", "section_no"], "left")
        .join(first.select("document_id", "filename"), "document_id")
        .drop("section_no")
    )


def stream_ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, config: Config = DEFAULT,
    outcomes: str | None = None, trigger: dict | None = None,
):
    """Watch a folder; every new file is ingested, whatever its age, and re-ingestion replaces its chunks.

    What became of each file is written to ``outcomes`` (beside the target by default), one folder per batch.
    ``trigger``: when to run, e.g. ``{"processingTime": "1 minute"}``; by default once over all there is.
    """
    raw = spark.readStream.format("binaryFile").schema(schemas.FILES).option(
        "recursiveFileLookup", "true"
    ).load(source)
    log = f"{outcomes or target + '_outcomes'}/run={zlib.crc32(checkpoint.encode())}"

    def write(batch: DataFrame, number: int) -> None:
        # Idempotent: chunks replace those of the same document, so a retried batch changes nothing.
        described = settle(batch)
        # What earlier batches of this and of other runs accepted is the library that a file can repeat.
        earlier = _accepted(spark, outcomes or target + "_outcomes", f"{log}/batch={number}")
        found = settle(ingest.ingest_outcomes(described, config, library=earlier))
        accepted = found.where("status = 'accepted'").select("path")
        tables.write_chunks(ingest_batch(described.join(accepted, "path", "left_semi"), config), target)
        found.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return (
        tables.describe_files(raw).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _accepted(spark: SparkSession, log: str, batch: str) -> DataFrame | None:
    """document_id and path of all files accepted before, without those of the batch that is being written (again)."""
    try:
        rows = spark.read.option("recursiveFileLookup", "true").schema(OUTCOMES).parquet(log)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    own = F.col("_metadata.file_path").contains(batch.split("://")[-1] + "/")
    return rows.where((F.col("status") == "accepted") & ~own).select("document_id", "path")


def stream_latest_status(events: DataFrame) -> DataFrame:
    """Update-mode fold of status events; the same expressions as the batch fold."""
    return library.fold_status(events)


def stream_reuse(
    questions: DataFrame, answers: DataFrame, config: Config = DEFAULT, late: str = "10 minutes"
) -> DataFrame:
    """questions(question_id, entry, asked_at) answered by answers(entry, stored_at) within the lifetime."""
    asked = questions.withWatermark("asked_at", late).alias("q")
    stored = answers.withWatermark("stored_at", late).alias("a")
    life = f"interval {config.cache_ttl_seconds} seconds"
    return asked.join(stored, F.expr(
        f"q.entry = a.entry and q.asked_at >= a.stored_at and q.asked_at < a.stored_at + {life}"
    ))


def stream_run_metrics(
    runs: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour"
) -> DataFrame:
    return history.run_metrics(runs.withWatermark("created_at", late), width, slide)


def stream_chat_sessions(runs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs per chat and burst of activity."""
    return runs.withWatermark("created_at", late).groupBy(
        "chat_id", F.session_window("created_at", gap).alias("session")
    ).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("answered").cast("int")).alias("answered_runs"))
