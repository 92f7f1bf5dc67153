"""The driver tables seen as the engine's tables (documents, chunks, questions, runs, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.sources.tables import read_table, spread


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """documents or pages, spread over the cores where the file is too small to be."""
    return spread(read_table(spark, folder, name), "doc_id" if name == "documents" else "page_id")


EPOCH_2026 = 1767225600  # 2026-01-01 00:00:00 UTC


def library(spark: SparkSession, folder: str) -> DataFrame:
    """documents as uploaded files; labels give status and decide who has a summary."""
    docs, labels = texts(spark, folder), read_table(spark, folder, "labels")
    extension = (
        F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".md")
        .when(F.col("lang") == "de", ".docx").otherwise(".pdf")
    )
    mime = (
        F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "fr", "text/markdown")
        .when(F.col("lang") == "de", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .otherwise("application/pdf")
    )
    status = (
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "PROCESSING")
        .when(F.col("quality") == 0, "FAILED").otherwise("READY")
    )
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("doc_"), "doc_id", extension).alias("filename"), mime.alias("mime"),
        F.octet_length("text").cast("bigint").alias("size_bytes"), F.col("text").alias("content"), "source",
        F.timestamp_seconds(F.lit(EPOCH_2026) + F.col("doc_id") * 60).alias("created_at"), status.alias("status"),
        F.when(F.col("quality").isNotNull(), F.substring_index("text", "\n", 1)).alias("summary"),
        F.concat(F.lit("files/"), "source", F.lit("/"), "doc_id").alias("storage_path"),
    )


def chunks(spark: SparkSession, folder: str, vectors: bool = True) -> DataFrame:
    """documents as chunks of books of twenty; the paired embedding gives vector and section."""
    docs = texts(spark, folder)
    book, index = F.floor(F.col("doc_id") / 20), F.col("doc_id") % 20
    base = docs.select(
        "doc_id", F.concat_ws(":", book.cast("string"), index.cast("string")).alias("chunk_id"),
        book.cast("string").alias("document_id"),
        F.concat(F.lit("book_"), book, F.lit(".txt")).alias("filename"),
        index.alias("chunk_index"), F.col("text").alias("content"),
        (F.floor(index / 4) + 1).cast("int").alias("page_number"),
    )
    if not vectors:
        return base
    vecs = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return base.join(vecs, "doc_id", "left").select(
        "*", F.concat(F.lit("s"), "label").alias("section_id"),
        F.concat(F.lit("Section "), "label").alias("section_title"),
        F.concat(F.lit("Part "), F.col("label") % 3, F.lit(" > Section "), "label").alias("section_path"),
    ).drop("label")


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``chunks`` without their vectors, for readers of the text alone.

    The join with the embeddings only repeats chunks whose id has several vectors. Where no id has, texts stay where they lie.
    """
    base = chunks(spark, folder, vectors=False)
    copies = read_table(spark, folder, "embeddings").where("vec_id is not null").groupBy(
        F.col("vec_id").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("_copies")).where("_copies > 1")
    if copies.isEmpty():
        return base
    times = F.sequence(F.lit(1), F.coalesce("_copies", F.lit(1)))
    return base.join(copies, "doc_id", "left").withColumn("_copy", F.explode(times)).select(*base.columns)


def books(spark: SparkSession, folder: str) -> DataFrame:
    """One document per book of chunks (twenty rows at most per group)."""
    parts = chunks(spark, folder, vectors=False).join(
        read_table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return parts.groupBy("document_id", "filename").agg(
        F.array_join(F.transform(ordered, lambda c: c.content), "\n\n").alias("content"),
        F.when(F.count("quality") > 8, F.min_by("content", "chunk_index")).alias("summary"),
        F.when(F.count(F.when(F.col("quality") == 0, 1)) >= 3, "FAILED").otherwise("READY").alias("status"),
    ).withColumn(
        "created_at", F.timestamp_seconds(F.lit(EPOCH_2026) + F.col("document_id").cast("bigint") * 86400)
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items; one without a vector of its own can still be asked by its words."""
    items = read_table(spark, folder, "benchmark")
    vectors = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return items.join(vectors, "item_id", "left").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"), "embedding"
    )


def question_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text that can be asked: benchmark items and all conversation turns of users."""
    items = read_table(spark, folder, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("question_id"), F.col("text").alias("question")
    )
    turns = read_table(spark, folder, "conversations").where("role = 'user'").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("question_id"), F.col("text").alias("question")
    )
    return items.unionByName(turns)


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts phrased as the kinds of message a user sends, by the part's own values."""
    part = read_table(spark, folder, "part")
    n = F.col("p_size") % 10
    name, brand = F.col("p_name"), F.col("p_brand")
    question = (
        F.when(n == 0, F.concat(F.lit("Which documents mention "), name, F.lit("?")))
        .when(n == 1, F.concat(F.lit("What does each policy say about "), name, F.lit("?")))
        .when(n == 2, F.concat(F.lit("I have taken "), "p_size", F.lit(" of "), F.lit("22 "), name, F.lit(". How many are left?")))
        .when(n == 3, name)
        .when(n == 4, F.concat(F.lit("What about "), name, F.lit("?")))
        .when(n == 5, F.lit("Hello there!!"))
        .when(n == 6, F.lit("Thank you very much."))
        .when(n == 7, F.concat(F.lit("Compare "), name, F.lit(" across all the files of "), brand))
        .when(n == 8, F.concat(F.lit("How much "), name, F.lit(" of type "), "p_type", F.lit(" do employees of "), brand, F.lit(" get?")))
        .otherwise(F.concat(F.lit("total of "), "p_size", F.lit(" "), name, F.lit(" at "), "p_retailprice"))
    )
    return part.select(F.col("p_partkey").alias("question_id"), question.alias("question"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts and question_texts together."""
    made = prompts(spark, folder).select(F.concat(F.lit("p"), "question_id").alias("question_id"), "question")
    return made.unionByName(question_texts(spark, folder))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """events as answered questions: chat = user, kind of event = mode, value = latency."""
    mode = (
        F.when(F.col("event_type") == "view", "agentic").when(F.col("event_type") == "purchase", "hybrid")
        .when(F.col("event_type") == "signup", "custom").otherwise("naive")
    )
    item = F.get_json_object("props", "$.k").cast("bigint")
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("chat_id"),
        F.concat(F.lit("How is item  "), item, F.lit(" doing after "), "event_type", F.lit("?")).alias("question"),
        (F.col("event_type") != "error").alias("answered"), mode.alias("mode"),
        F.col("value").alias("latency_ms"), F.col("ts").alias("created_at"), item.alias("item"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """A user's row and the assistant's next row make one turn."""
    rows = read_table(spark, folder, "conversations")
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return rows.where("role = 'user'").join(answers, ["conv_id", "turn"], "left").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("run_id"), F.col("conv_id").alias("chat_id"),
        F.col("turn").alias("turn_index"), F.col("text").alias("question"), "answer",
        F.col("answer").isNotNull().alias("answered"),
        F.array(F.concat(F.lit("file_"), F.col("conv_id") % 7), F.concat(F.lit("file_"), F.col("turn") % 3)).alias("filenames"),
    )


def tree_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as documents with deep headings: level by part, page by quantity."""
    level = F.col("l_partkey") % 6
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"),
        F.concat(F.lit("part "), "l_partkey").alias("text"),
        F.when(level > 0, level).cast("int").alias("heading_level"),
        F.when(F.col("l_suppkey") % 3 > 0, F.col("l_quantity").cast("int")).alias("page_number"),
    )


def deep_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as documents of four orders with headings of levels 1 to 40."""
    level = F.col("l_partkey") % 41
    return read_table(spark, folder, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).cast("string").alias("document_id"),
        (F.col("l_orderkey") * 100_000_000_000 + F.col("l_linenumber").cast("bigint") * 1_000_000_000
         + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), F.concat(F.lit("part "), "l_partkey").alias("text"),
        F.when(level > 0, level).cast("int").alias("heading_level"), F.lit(None).cast("int").alias("page_number"),
    )


def part_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as claims: a size of a type, stated by the document of its brand."""
    return read_table(spark, folder, "part").select(
        F.format_string("%010d", "p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"),
        F.concat("p_brand", F.lit(".md")).alias("filename"),
        F.concat(F.lit("Stores keep "), "p_size", F.lit(" units of the "), F.lower("p_type"),
                 F.lit(" kind. Ask for "), "p_name", F.lit(".")).alias("content"),
        F.when(F.col("p_brand") != "Brand#3", F.timestamp_seconds(
            F.lit(EPOCH_2026) + F.substring_index("p_brand", "#", -1).cast("bigint") * 86400)).alias("uploaded_at"),
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant texts with citation markers, by the row's own numbers."""
    rows = read_table(spark, folder, "conversations").where("role <> 'system'")
    marker = F.concat(F.lit(" ["), F.col("turn") + 1, F.lit(", "), F.col("conv_id") % 9, F.lit("] and ["), F.col("turn") + 1, F.lit("]"))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    answer = (
        F.when(kind == 0, F.concat("text", marker)).when(kind == 1, F.concat(F.lit("NOT_FOUND "), "text"))
        .when(kind == 2, marker).when(kind == 3, F.concat("text", marker, F.lit(" see [appendix]"))).otherwise(F.col("text"))
    )
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), answer.alias("answer"))
