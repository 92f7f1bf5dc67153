"""Helpers the operators share: lineage cuts, bounded batches, packs of documents and exchanged blobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the runs of bytes outside this set; bytes.split() uses exactly it.
SPACES = b" \t\n\x0b\x0c\r"

#: Text held by one pack, in bytes. A longer document has a pack of its own.
PACK_BYTES = 4 << 20
#: Rows that wait together on their way to Python, in bytes. An executor holds several times that per task outside its heap.
BATCH_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that setting is missing, the warehouse (or, in one local JVM, a temporary folder) is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            local = context.master.startswith("local[") or context.master == "local"
            folder = tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _held(spark: SparkSession, setting: str, value):
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written inside go when it is written, not when the driver next collects its garbage."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def small_batches(spark: SparkSession):
    """What is written inside passes Python in batches of about BATCH_BYTES, not of all packs that a partition has.

    Nor are whole column chunks read at once, for which every reading thread keeps a buffer outside the heap.
    """
    with _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), _held(spark, "parquet.hadoop.vectored.io.enabled", "false"):
        yield


def stored(df: DataFrame) -> DataFrame:
    """Lineage cut by a compressed table in the shared folder, for rows that a checkpoint would lay out in full.

    Later steps read only the columns they use.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = PACK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each holds about ``limit`` bytes, so memory follows a batch and not a partition."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < len(sizes):
            yield batch.slice(start)


def ids_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def packed(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """One row per pack of documents: gid long, body binary (a compressed Arrow stream of doc_id and text as binary).

    Packs are cut inside the tasks that read the documents and lie in buckets by their number. What later steps ask and
    answer per pack refers to the same documents however often tasks run.
    """
    docs = ids_and_text(docs)

    def pack(batches):
        # A pack's number holds its task and its place within it.
        gid, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                if ids and held + len(text) > pack_bytes:
                    yield _pack_row(gid, ids, texts)
                    gid, ids, texts, held = gid + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield _pack_row(gid, ids, texts)

    return in_buckets(docs.mapInArrow(pack, "gid long, body binary"), text_size(docs) // (2 * pack_bytes))


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    with small_batches(docs.sparkSession):
        return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first().size


def in_buckets(packs: DataFrame, buckets: int) -> DataFrame:
    """Packs as a table in the shared folder, bucketed by ``gid``: in a join by it only the other side moves.

    That holds for a side dealt into the same number of parts, which the column ``gid`` tells (``bucket_count``).
    """
    spark, name, buckets = packs.sparkSession, f"packs_{uuid.uuid4().hex}", int(max(8, buckets))
    dealt = packs.repartition(buckets, "gid").withMetadata("gid", {"buckets": buckets})
    with shuffles_dropped(spark), small_batches(spark):
        dealt.write.bucketBy(buckets, "gid").option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def bucket_count(packs: DataFrame) -> int:
    return packs.schema["gid"].metadata["buckets"]


def _pack_row(gid: int, ids: list, texts: list) -> pa.RecordBatch:
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
    return pa.RecordBatch.from_pydict({"gid": [gid], "body": [to_blob(table)]})


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def crc_rest(ids: list, modulus: int) -> np.ndarray:
    """crc32 of the decimal id, modulo ``modulus``; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids], np.int64)


def crc_bucket(id_column: str, modulus: int):
    """The same as a column expression."""
    return F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")) % modulus


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession
