"""Tables and files in, tables out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute rows by key when the scan has fewer splits than there are cores.

    Text work is CPU-bound, and one large row group would leave the other cores idle. A
    table with splits enough (any large one) is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def describe_files(raw: DataFrame) -> DataFrame:
    """Binary files with name, declared type, first bytes and (for text types) the text."""
    extension = F.lower(F.substring_index("path", ".", -1))
    mime = F.lit("application/octet-stream")
    for suffix, kind in MIME.items():
        mime = F.when(extension == suffix, kind).otherwise(mime)
    textual = extension.isin("txt", "md", "html")
    return raw.select(
        "path", F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("size"),
        mime.alias("mime"), F.substring("content", 1, 8).alias("head"),
        F.sha2("content", 256).alias("sha256"),
        F.when(textual, F.col("content").cast("string")).alias("content"),
        F.col("modificationTime").alias("created_at"),
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return describe_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def append_runs(runs: DataFrame, path: str) -> None:
    """One row per answered question, laid out by day: the rows of a day come together first, in parts where they are many.

    Else every task would write a file into each day that it holds a row of.
    """
    dated = runs.withColumn("day", F.to_date("created_at"))
    dated.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)


def read_runs(spark: SparkSession, path: str, since: str | None = None, schema: str | None = None) -> DataFrame:
    """Stored runs; ``since`` (a date) leaves out whole days without opening them.

    ``schema`` (``schemas.RUNS``) makes runs stored before a column existed readable, without opening every footer.
    """
    runs = (spark.read.schema(schema + ", day date") if schema else spark.read).parquet(path)
    return runs if since is None else runs.where(F.col("day") >= F.to_date(F.lit(since)))


def write_chunks(chunks: DataFrame, path: str, doc: str = "document_id", buckets: int = 4096) -> None:
    """Add chunks; those of documents ingested before are replaced.

    Documents the table does not hold are appended. Only buckets that hold a re-ingested
    document are read (dynamic partition pruning) and rewritten; dynamic overwrite stages
    the result and swaps the buckets on commit. A repeated call finds its documents
    stored and replaces them with the same rows.
    """
    from corpusframe.operators.chunking import replace_chunks

    spark = chunks.sparkSession
    new = chunks.withColumn("doc_bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")).persist()
    try:
        stored = _stored(spark, path)
        if stored is None:
            _by_bucket(new, "append", path)
            return
        ids = new.select("doc_bucket", doc).distinct()
        known = ids.join(stored.select("doc_bucket", doc), ["doc_bucket", doc], "left_semi").persist()
        if not known.isEmpty():
            touched = stored.join(known.select("doc_bucket").distinct(), "doc_bucket", "left_semi")
            again = new.join(known.select(doc), doc, "left_semi")
            _by_bucket(replace_chunks(touched.select(*again.columns), again, doc), "overwrite", path)
        _by_bucket(new.join(known.select(doc), doc, "left_anti"), "append", path)
        known.unpersist()
    finally:
        new.unpersist()


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _by_bucket(df: DataFrame, mode: str, path: str) -> None:
    # One writer per bucket, or a task would open a file in each of them.
    placed = df.repartition("doc_bucket")
    placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)
