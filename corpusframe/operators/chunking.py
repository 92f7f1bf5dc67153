"""Sections to chunks, chunk pages, summary windows, profiles and counts."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.operators import structure
from corpusframe.operators.scale import in_steps
from corpusframe.session import ship

# Tried in order; the last one cuts between characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _cut(span: tuple[int, int], body: str, separators: tuple[str, ...], size: int, overlap: int):
    """Spans of at most ``size`` characters where separators allow it."""
    start, end = span
    at = next((i for i, s in enumerate(separators) if s == "" or body.find(s, start, end) >= 0),
              len(separators) - 1)
    separator, finer = separators[at], separators[at + 1:]
    if separator == "":
        marks = list(range(start, end))
    else:
        # A separator leads the piece that follows it.
        marks, here = [start], body.find(separator, start, end)
        while here >= 0:
            if here > start:
                marks.append(here)
            here = body.find(separator, here + len(separator), end)
    pieces = [p for p in zip(marks, marks[1:] + [end]) if p[1] > p[0]]
    run: list[tuple[int, int]] = []
    for piece in pieces:
        if piece[1] - piece[0] < size:
            run.append(piece)
            continue
        yield from _merge(run, size, overlap)
        run = []
        if finer:
            yield from _cut(piece, body, finer, size, overlap)
        else:
            yield piece
    yield from _merge(run, size, overlap)


def _merge(run: list[tuple[int, int]], size: int, overlap: int):
    """Join neighbouring pieces up to ``size``; each next span repeats up to ``overlap``."""
    first = 0
    for i, (left, right) in enumerate(run):
        if i > first and right - run[first][0] > size:
            yield run[first][0], left
            while first < i and (
                left - run[first][0] > overlap or right - run[first][0] > size
            ):
                first += 1
    if first < len(run):
        yield run[first][0], run[-1][1]


def split_text(body: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start offset, chunk) pairs; white space at the ends is dropped, empties too."""
    chunks, probe = [], 0
    for left, right in _cut((0, len(body)), body, SEPARATORS, size, overlap):
        piece = body[left:right].strip()
        if not piece:
            continue
        # The offset is searched from just before where the overlap may begin.
        start = body.find(piece, max(0, probe))
        chunks.append((start, piece))
        probe = start + len(piece) - overlap
    return chunks


def _splitter(size: int, overlap: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, 2):
            row, number, starts, pieces = [], [], [], []
            for at, body in enumerate(batch.column(2).to_pylist()):
                for place, (start, piece) in enumerate(split_text(body or "", size, overlap)):
                    row.append(at)
                    number.append(place)
                    starts.append(start)
                    pieces.append(piece)
            of = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(pieces, pa.string())],
                ["doc", "section_no", "piece_no", "start", "content"])

    return split


def chunk_sections(
    sections: DataFrame, doc: str = "document_id", config: Config = DEFAULT
) -> DataFrame:
    """Chunks of each section's text, numbered over the whole document.

    sections(doc, section_no, text). Chunks count in the order they are cut, as two can start
    at one place. Cutting runs in Arrow batches where the section
    lies; only the numbering shuffles, by document.
    """
    ship(sections.sparkSession)
    key_type = sections.schema[doc].dataType.simpleString()
    pieces = sections.select(doc, F.col("section_no").cast("long"), "text").mapInArrow(
        _splitter(config.chunk_size, config.chunk_overlap),
        f"doc {key_type}, section_no long, piece_no int, start int, content string",
    )
    order = Window.partitionBy("doc").orderBy("section_no", "piece_no")
    return pieces.withColumn("chunk_index", F.row_number().over(order) - 1).select(
        F.col("doc").alias(doc), "section_no", "chunk_index",
        F.concat_ws(":", F.col("doc").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "start", "content",
    )


def chunk_windows(
    docs: DataFrame, doc: str = "document_id", content: str = "content", config: Config = DEFAULT
) -> DataFrame:
    """Fixed-size overlapping windows over whole texts, all in native expressions."""
    size, stride = config.chunk_size, config.chunk_size - config.chunk_overlap
    length = F.length(content)
    last = F.greatest(F.ceil((length - config.chunk_overlap) / stride) - 1, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda i: i * stride)
    return (
        docs.select(doc, content, F.posexplode(starts).alias("chunk_index", "start"))
        .select(
            doc, "chunk_index", F.col("start").cast("int").alias("start"),
            F.col(content).substr(F.col("start").cast("int") + 1, F.lit(size)).alias("content"),
        )
        .where(F.trim("content") != "")
    )


def block_spans(section_blocks: DataFrame, doc: str = "document_id") -> DataFrame:
    """[start, end) of every block in its section's joined text."""
    before = (
        Window.partitionBy(doc, "section_no").orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    length = F.length("text")
    start = F.coalesce(F.sum(length + len(structure.SEPARATOR)).over(before), F.lit(0))
    return section_blocks.select(
        doc, "section_no", start.alias("start"), (start + length).alias("end"), "page_number"
    )


def chunk_pages(chunks: DataFrame, spans: DataFrame, doc: str = "document_id") -> DataFrame:
    """Page of the block a chunk starts in: an as-of join by offset, as one window pass.

    chunks(doc, section_no, chunk_index, start), spans(doc, section_no, start, end, page_number).
    """
    marks = spans.select(
        doc, "section_no", "start", F.lit(0).alias("_kind"), "end", "page_number",
        F.lit(None).cast("bigint").alias("chunk_index"),
    ).unionByName(chunks.select(
        doc, "section_no", "start", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("end"),
        F.lit(None).cast("int").alias("page_number"), F.col("chunk_index").cast("bigint").alias("chunk_index"),
    ))
    so_far = (
        Window.partitionBy(doc, "section_no").orderBy("start", "_kind", "chunk_index")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    whole = Window.partitionBy(doc, "section_no")
    block = F.last(F.when(F.col("_kind") == 0, F.struct("start", "end", "page_number")), ignorenulls=True)
    return (
        marks.withColumn("_block", block.over(so_far))
        .withColumn("_page_before", F.last("page_number", ignorenulls=True).over(so_far))
        .withColumn("_fallback", F.min("page_number").over(whole))
        .where("_kind = 1")
        .withColumn("page_number", F.when(
            F.col("start") < F.col("_block.end"), F.coalesce("_block.page_number", "_fallback")
        ).otherwise(F.coalesce("_page_before", "_fallback")))
        .select(doc, "section_no", "chunk_index", "start", "page_number")
    )


def summary_windows(
    docs: DataFrame, doc: str = "document_id", content: str = "content", config: Config = DEFAULT
) -> DataFrame:
    """At most ``summary_parts`` windows that cover, or evenly sample, the whole text."""
    window, parts = config.summary_window, config.summary_parts
    length = F.length(content)
    needed = F.ceil(length / window).cast("int")
    stride = F.floor((length - window) / (parts - 1)).cast("int") if parts > 1 else F.lit(0)
    count = F.least(F.greatest(needed, F.lit(1)), F.lit(parts))
    step = F.when(needed <= parts, F.lit(window)).otherwise(stride)
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
    return docs.select(doc, content, F.posexplode(starts).alias("part", "start")).select(
        doc, "part", "start",
        F.col(content).substr(F.col("start") + 1, F.lit(window)).alias("window_text"),
    )


def document_profiles(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """docs(document_id, filename, summary, content) -> text documents are ranked on."""
    opening = F.substring("content", 1, config.profile_characters)
    body = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(opening)
    parts = F.filter(F.array(F.col("filename"), body), lambda p: p.isNotNull() & (p != ""))
    return docs.withColumn("profile", F.array_join(parts, " "))


def chunk_counts(docs: DataFrame, chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """Chunk count per document, zero where nothing is indexed; rows without an id skipped."""
    counts = chunks.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    return docs.join(counts, doc, "left").withColumn(
        "chunk_count", F.coalesce("_n", F.lit(0)).cast("bigint")
    ).drop("_n")


def document_structure(
    docs: DataFrame, blocks: DataFrame, chunks: DataFrame, doc: str = "document_id"
) -> DataFrame:
    """Counts, pages and the section list per document."""
    pages = blocks.groupBy(doc).agg(F.max("page_number").alias("page_count"), F.count(F.lit(1)).alias("_blocks"))
    texts = structure.section_text(blocks, doc).select(
        doc, "section_no", F.length("text").alias("character_count"), "page_start", "page_end"
    )
    entry = F.struct(
        "section_no", "section_id", "title", "level", "parent_section_id", "path",
        F.col("character_count").isNotNull().alias("has_content"),
        F.coalesce("character_count", F.lit(0)).alias("character_count"), "page_start", "page_end",
    )
    sections = (
        structure.section_tree(blocks, doc).join(texts, [doc, "section_no"], "left")
        .groupBy(doc).agg(F.array_sort(F.collect_list(entry)).alias("sections"))
    )
    return (
        chunk_counts(docs, chunks, doc).join(pages, doc, "left").join(sections, doc, "left")
        .withColumn("character_count", F.length(F.coalesce("content", F.lit(""))))
        .withColumn("sections", F.coalesce("sections", F.array().cast(sections.schema["sections"].dataType)))
        .withColumn("structure_available", F.coalesce(F.col("_blocks") > 0, F.lit(False)))
        .drop("_blocks", "content")
    )


def replace_chunks(existing: DataFrame, new: DataFrame, doc: str = "document_id") -> DataFrame:
    """Every chunk of a re-ingested document is replaced, so none is left behind."""
    ids = new.select(doc).distinct()
    return existing.join(ids, doc, "left_anti").unionByName(new)


def hits_from_metadata(raw: DataFrame) -> DataFrame:
    """Stored fields to hit fields; anything missing or unreadable gets its default."""
    document = F.coalesce("document_id", F.lit("unknown"))
    return raw.withColumns({
        "chunk_id": F.coalesce("chunk_id", F.concat_ws(":", document, F.col("chunk_index").cast("string"))),
        "document_id": document,
        "filename": F.coalesce("filename", F.lit("unknown")),
        "page_number": F.trim(F.col("page_number").cast("string")).try_cast("int"),
    })
