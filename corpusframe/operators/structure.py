"""Blocks to a section tree.

Sections are numbered by windows per document, whose size the upload gate bounds. Their parents come from one pass over
the headings in order, with a stack of the open sections that starts anew at every document: a heading closes all open
sections of its own or a deeper level, however deep levels go.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions import fixed
from corpusframe.session import ship

SEPARATOR = "\n\n"


def _with_preamble(blocks: DataFrame, doc: str) -> DataFrame:
    """Body text before any heading gets a synthetic level-1 section in front."""
    order = Window.partitionBy(doc).orderBy("pos")
    opens = F.col("_previous").isNull() & F.col("heading_level").isNull()
    kinds = F.when(opens, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    synthetic = F.col("_kind") == 0
    return (
        blocks.withColumn("_previous", F.lag("pos").over(order))
        .withColumn("_kind", F.explode(kinds))
        .drop("_previous")
        .withColumn("heading_level", F.when(synthetic, 1).otherwise(F.col("heading_level")))
        .withColumn("text", F.when(synthetic, fixed.PREAMBLE).otherwise(F.col("text")))
        .withColumn("page_number", F.when(~synthetic, F.col("page_number")))
    )


def _placed(blocks: DataFrame, doc: str) -> DataFrame:
    order = Window.partitionBy(doc).orderBy("pos", "_kind")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_preamble(blocks, doc)
        .withColumn("_heading", F.col("heading_level").isNotNull())
        .withColumn("section_no", F.sum(F.col("_heading").cast("int")).over(running))
    )


def _stacked(batches):
    """Parent number and path of titles of every heading; rows come by document and in order."""
    document, stack = object(), []
    for batch in batches:
        parents, titles, ends = [], [], [0]
        for name, number, title, level in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if name != document:
                document, stack = name, []
            while stack and stack[-1][0] >= level:
                stack.pop()
            parents.append(stack[-1][1] if stack else None)
            stack.append((level, number, title))
            titles.extend(entry[2] for entry in stack)
            ends.append(len(titles))
        yield pa.RecordBatch.from_arrays([
            *batch.columns, pa.array(parents, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(titles, pa.string()))],
            names=[*batch.schema.names, "parent", "path"])


def section_tree(blocks: DataFrame, doc: str = "document_id") -> DataFrame:
    """One row per section: id, title, level, parent id and the path of titles. Levels may be of any depth."""
    ship(blocks.sparkSession)
    headings = _placed(blocks, doc).where("_heading").select(
        doc, "section_no", F.col("text").alias("title"), F.col("heading_level").cast("int").alias("level"))
    kind = headings.schema[doc].dataType.simpleString()
    # A document stands in one partition, in order; the stack goes over its rows once.
    ordered = headings.repartition(doc).sortWithinPartitions(doc, "section_no")
    walked = ordered.mapInArrow(_stacked, f"`{doc}` {kind}, section_no long, title string, level int, parent long, path array<string>")
    return walked.select(
        doc, "section_no", F.concat(F.lit("s"), "section_no").alias("section_id"), "title", "level",
        F.concat(F.lit("s"), "parent").alias("parent_section_id"), "path")


def section_blocks(blocks: DataFrame, doc: str = "document_id") -> DataFrame:
    """Body blocks with the number of the section that owns them."""
    return (
        _placed(blocks, doc)
        .where("not _heading")
        .select(doc, "section_no", "pos", "text", "page_number")
    )


def section_text(blocks: DataFrame, doc: str = "document_id") -> DataFrame:
    """Own text and page span of every section that has blocks."""
    owned = section_blocks(blocks, doc)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return owned.groupBy(doc, "section_no").agg(
        F.array_join(F.transform(ordered, lambda b: b.text), SEPARATOR).alias("raw_text"),
        F.min("page_number").alias("page_start"),
        F.max("page_number").alias("page_end"),
        F.count(F.lit(1)).alias("block_count"),
    ).withColumn("text", F.expr(r"regexp_replace(raw_text, '(?U)^\\s+|\\s+$', '')"))


def content_sections(tree: DataFrame, blocks: DataFrame, doc: str = "document_id") -> DataFrame:
    """Sections that hold text of their own, the ones worth chunking."""
    return tree.join(section_blocks(blocks, doc).select(doc, "section_no"), [doc, "section_no"], "left_semi")


def section_outline(tree: DataFrame, doc: str = "document_id", limit: int | None = None) -> DataFrame:
    """Indented ``- [id] title`` lines per document."""
    shown = tree if limit is None else tree.where(F.col("section_no") <= limit)
    line = F.concat(
        F.expr("repeat('  ', greatest(level - 1, 0))"),
        F.lit("- ["), F.col("section_id"), F.lit("] "), F.col("title"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("section_no", line.alias("line"))))
    return shown.groupBy(doc).agg(
        F.array_join(F.transform(ordered, lambda s: s.line), "\n").alias("outline")
    )
