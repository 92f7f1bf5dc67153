"""A stored keyword index that grows by segments and whose blocks let a search stop early.

Every refresh writes one segment: the new chunks with their term counts, their postings in blocks, and the chunks that
have gone as tombstones on the segments before. ``merged`` rewrites all of them into one. A block holds postings of one
term whose share of the score is alike (a level), at most some BLOCK of them, so a term of any frequency spreads over
many rows; its largest count and shortest chunk bound the score it can add, whatever the corpus has become.

A search first reads the best level of every query term. What a question finds there limits what it still needs: a block
is read only if it, together with the most that the question's other terms can add, may reach the k-th best score. Each
chunk that can still matter has all its postings in such blocks, so their sums are exact and nothing is looked up twice.

    path/counts/segment=n     chunk_id, document_id, dl, terms
    path/blocks/segment=n/bucket=b   term, level, n, max_tf, min_dl, postings
    path/gone/segment=n       chunk_id: no longer live in segments below n
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import fixed
from corpusframe.operators import keyword
from corpusframe.operators.scale import join_hot_keys, only, top_k
from corpusframe.session import settle, ship

#: Postings of a block, about; levels of the share a posting can add; folders that terms are spread over.
BLOCK = 1024
LEVELS = 12
BUCKETS = 32
#: Postings that one writer of a folder takes.
WRITER = 20_000_000
#: Bytes of text that are cut and counted together.
TEXT = 4 << 20

_POSTING = "struct<chunk_id: string, document_id: string, tf: int, dl: int>"
_COUNTS = "chunk_id string, document_id string, dl int, terms array<struct<term: string, tf: int>>, segment int"
_BLOCKS = f"term string, level int, n bigint, max_tf int, min_dl int, postings array<{_POSTING}>, segment int, bucket int"
_GONE = "chunk_id string, segment int"


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    path: str
    segments: tuple[int, ...]

    def _part(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("segment").isin(list(self.segments)))

    @property
    def blocks(self) -> DataFrame:
        return self._part("blocks", _BLOCKS)

    @property
    def gone(self) -> DataFrame:
        """chunk_id, below: the first segment that a chunk's tombstone leaves alone."""
        return self._part("gone", _GONE).groupBy("chunk_id").agg(F.max("segment").alias("below"))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (chunk_id, segment) without those of chunks that have gone since."""
        if len(self.segments) == 1:
            return rows
        marked = rows.join(self.gone, "chunk_id", "left")
        return marked.where(F.col("below").isNull() | (F.col("segment") >= F.col("below"))).drop("below")

    @property
    def counts(self) -> DataFrame:
        return self.live(self._part("counts", _COUNTS))

    def statistics(self, config: Config = DEFAULT) -> keyword.KeywordIndex:
        """Live term and corpus statistics, read off the stored counts; no text is cut again."""
        counts = self.counts.drop("segment")
        return keyword._index(counts, counts, config)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _gain(tf: Column, dl: Column, avgdl: Column, config: Config) -> Column:
    k1, b = config.bm25_k1, config.bm25_b
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _write_segment(spark: SparkSession, path: str, number: int, chunks: DataFrame, config: Config) -> None:
    _counted(chunks).write.mode("overwrite").parquet(f"{path}/counts/segment={number}")
    counts = spark.read.schema(_COUNTS).parquet(f"{path}/counts/segment={number}")
    _write_blocks(counts, f"{path}/blocks/segment={number}", config)


def _counted(chunks: DataFrame) -> DataFrame:
    """The rows of ``keyword.counted``, terms of a chunk ascending. Texts are cut and counted some megabytes at a time."""
    ship(chunks.sparkSession)
    texts = chunks.select(
        F.col("chunk_id").cast("string"), F.col("document_id").cast("string"), F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    # All tokens are ASCII: other bytes part them.
    table = bytes(c if c < 128 and re.fullmatch(fixed.TOKEN, chr(c)) else 32 for c in range(256))
    kinds = pa.struct([("term", pa.string()), ("tf", pa.int32())])

    def count(batches):
        for batch in (step for whole in batches for step in _texts(whole)):
            words, sizes = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                own = text.translate(table).split()
                words += own
                sizes.append(len(own))
            found = pa.array(words, pa.binary()).dictionary_encode()
            order = pc.sort_indices(found.dictionary).to_numpy()
            rank, width = np.empty(len(order), np.int64), max(len(order), 1)
            rank[order] = np.arange(len(order))
            held, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + rank[found.indices.to_numpy()], return_counts=True)
            terms = found.dictionary.take(pa.array(order[held % width])).cast(pa.string())
            runs = pa.StructArray.from_arrays([terms, pa.array(tf, pa.int32())], fields=list(kinds))
            ends = np.searchsorted(held // width, np.arange(len(sizes) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)],
                ["chunk_id", "document_id", "dl", "terms"])

    return texts.mapInArrow(count, "chunk_id string, document_id string, dl int, terms array<struct<term: string, tf: int>>")


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about TEXT bytes of content."""
    ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TEXT, "right")))
        yield batch.slice(low, high - low)
        low = high


def _write_blocks(counts: DataFrame, path: str, config: Config) -> None:
    """Every task lays the postings of its chunks into blocks, a batch at a time, and only blocks move."""
    # Levels only sort postings by what they can add; the mean length of this segment is good enough for that.
    mean = only(counts.agg(F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl")), "avgdl")
    own = counts.select("chunk_id", "document_id", "terms", "dl", mean.alias("avgdl"))
    schema, block, k1, b = "term string, level int, n bigint, max_tf int, min_dl int, postings array<" + _POSTING + ">", BLOCK, config.bm25_k1, config.bm25_b
    ship(counts.sparkSession)

    def lay(batches):
        for batch in (step for whole in batches for step in keyword._steps(whole, whole.num_rows)):
            lists = batch.column(2)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            if not len(row):
                continue
            runs = lists.flatten()
            words, tf = runs.field("term").dictionary_encode(), runs.field("tf").to_numpy()
            dl = batch.column(3).to_numpy()[row]
            share = tf / (tf + k1 * (1 - b + b * dl / batch.column(4)[0].as_py()))
            level = np.minimum(np.floor(share * LEVELS), LEVELS - 1).astype(np.int64)
            key = words.indices.to_numpy() * np.int64(LEVELS) + level
            order = np.argsort(key, kind="stable")
            key, row, tf, dl = key[order], row[order], tf[order], dl[order]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            # Of a longer run every ``block`` postings are a block.
            within = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
            begins = np.flatnonzero(within % block == 0)
            postings = pa.StructArray.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())],
                ["chunk_id", "document_id", "tf", "dl"])
            yield pa.RecordBatch.from_arrays([
                words.dictionary.take(pa.array(key[begins] // LEVELS)), pa.array(key[begins] % LEVELS, pa.int32()),
                pa.array(np.diff(np.append(begins, len(key))), pa.int64()), pa.array(np.maximum.reduceat(tf, begins), pa.int32()),
                pa.array(np.minimum.reduceat(dl, begins), pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)), pa.int32()), postings)],
                ["term", "level", "n", "max_tf", "min_dl", "postings"])

    placed = own.mapInArrow(lay, schema).withColumn("bucket", _bucket(F.col("term")))
    # Sorted files: row groups of other terms are skipped by their statistics.
    total = counts.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    writers = 1 + total // (BUCKETS * WRITER)
    placed.repartition("bucket", F.pmod(F.xxhash64("term", "level"), F.lit(writers))).sortWithinPartitions("bucket", "term").write.mode(
        "overwrite").partitionBy("bucket").parquet(path)


def write_index(chunks: DataFrame, path: str, config: Config = DEFAULT) -> StoredIndex:
    """A new index of chunks(chunk_id, document_id, content) with one segment."""
    spark = chunks.sparkSession
    _write_segment(spark, path, 0, chunks, config)
    _no_chunks(spark).write.mode("overwrite").parquet(f"{path}/gone/segment=0")
    _commit(spark, path, (0,))
    return StoredIndex(spark, path, (0,))


def _no_chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "chunk_id string")


def _commit(spark: SparkSession, path: str, segments: tuple[int, ...]) -> None:
    """What readers see changes with one small table, written after all others."""
    version = (max(_versions(spark, path), default=-1)) + 1
    rows = spark.createDataFrame([(n,) for n in segments], "segment int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/version={version}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    try:
        return [r["version"] for r in spark.read.schema("segment int, version int").parquet(f"{path}/state").select("version").distinct().collect()]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    """The newest committed state."""
    state = spark.read.schema("segment int, version int").parquet(f"{path}/state")
    newest = state.where(F.col("version") == max(_versions(spark, path)))
    return StoredIndex(spark, path, tuple(sorted(r["segment"] for r in newest.collect())))


def changes(index: StoredIndex, chunks: DataFrame) -> DataFrame:
    """chunk_id, change: what a refresh would add and remove."""
    known, live = index.counts.select("chunk_id"), chunks.select("chunk_id")
    return live.join(known, "chunk_id", "left_anti").withColumn("change", F.lit("added")).unionByName(
        known.join(live, "chunk_id", "left_anti").withColumn("change", F.lit("removed")))


def refresh(index: StoredIndex, chunks: DataFrame, config: Config = DEFAULT) -> StoredIndex:
    """Bring the index up to date with chunks: one segment of new chunks, tombstones for those that have gone.

    Stored segments are not rewritten, and only new text is cut. A refresh that was interrupted leaves no trace in what
    readers see; the next one writes over its files. Nothing new and nothing gone: the index stays as it is.
    """
    known = index.counts.select("chunk_id")
    fresh = chunks.join(known, "chunk_id", "left_anti")
    gone = known.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    if fresh.isEmpty() and gone.isEmpty():
        return index
    number = max(index.segments) + 1
    _write_segment(index.spark, index.path, number, fresh, config)
    gone.distinct().write.mode("overwrite").parquet(f"{index.path}/gone/segment={number}")
    return _with(index, (*index.segments, number))


def _with(index: StoredIndex, segments: tuple[int, ...]) -> StoredIndex:
    _commit(index.spark, index.path, segments)
    return replace(index, segments=segments)


def merged(index: StoredIndex, config: Config = DEFAULT) -> StoredIndex:
    """All live chunks in one segment, from their stored counts. Readers of the old segments are not disturbed."""
    if len(index.segments) == 1:
        return index
    number = max(index.segments) + 1
    index.counts.drop("segment").write.mode("overwrite").parquet(f"{index.path}/counts/segment={number}")
    counts = index.spark.read.schema(_COUNTS).parquet(f"{index.path}/counts/segment={number}")
    _write_blocks(counts, f"{index.path}/blocks/segment={number}", config)
    _no_chunks(index.spark).write.mode("overwrite").parquet(f"{index.path}/gone/segment={number}")
    return _with(index, (number,))


def _weights(questions: DataFrame, index: keyword.KeywordIndex, question: str) -> DataFrame:
    """question_id, term, weight, and the corpus' avgdl in every row."""
    asked = keyword.question_terms(questions, question)
    return asked.join(index.terms, "term").select(
        "question_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), only(index.corpus, "avgdl").alias("avgdl"))


def needed_blocks(
    questions: DataFrame, index: StoredIndex, statistics: keyword.KeywordIndex, top: int, config: Config = DEFAULT,
    question: str = "question",
) -> DataFrame:
    """question_id, term, level, weight of all blocks that a question has to read."""
    return _needed(questions, index, settle(_weights(questions, statistics, question)), top, config)


def _mean_length(weights: DataFrame) -> float:
    """The corpus' avgdl, from settled weights."""
    return weights.agg(F.max("avgdl").alias("avgdl")).first()["avgdl"] or 0.0


def _needed(questions: DataFrame, index: StoredIndex, weights: DataFrame, top: int, config: Config) -> DataFrame:
    avgdl = _mean_length(weights)
    asked = weights.drop("avgdl").withColumn("bucket", _bucket(F.col("term")))
    # Heads only: the postings are not read for this.
    heads = index.blocks.select("bucket", "term", "level", "n", "max_tf", "min_dl").groupBy("bucket", "term", "level").agg(
        F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    # Levels of the asked terms: read once, whatever is worked out from them.
    bounds = settle(asked.join(heads, ["bucket", "term"]).withColumn(
        "most", F.col("weight") * _gain(F.col("max_tf"), F.col("min_dl"), F.lit(avgdl), config)))
    per_term = bounds.groupBy("question_id", "term").agg(
        F.max(F.greatest("most", F.lit(0.0))).alias("term_most"), F.min(F.least("most", F.lit(0.0))).alias("term_least"))
    per_question = per_term.groupBy("question_id").agg(
        F.sum("term_most").alias("all_most"), F.sum("term_least").alias("all_least"))
    # The best levels of a term (it has LEVELS at most) that hold as many postings as are asked for.
    better = Window.partitionBy("question_id", "term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    leading = bounds.withColumn("_before", F.coalesce(F.sum("n").over(better), F.lit(0))).where(F.col("_before") < top)
    first = _found(settle(leading.select("question_id", "term", "level", "weight")), questions, index, avgdl, top, config)
    # A chunk's other terms can only lower its sum by what negative weights allow.
    known = settle(top_k(first, ["question_id"], [F.desc("score"), F.asc("chunk_id")], top).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("found"), F.min("score").alias("kth")))
    limits = per_question.join(known, "question_id", "left").select(
        "question_id", "all_most", F.when(F.col("found") >= top, F.col("kth") + F.col("all_least")).alias("limit"))
    reach = F.greatest("most", F.lit(0.0)) + F.col("all_most") - F.col("term_most")
    return bounds.join(per_term.select("question_id", "term", "term_most"), ["question_id", "term"]).join(limits, "question_id").where(
        F.col("limit").isNull() | (reach >= F.col("limit") - 2 * 10.0**-keyword.SCORE_DIGITS)).select(
        "question_id", "term", "level", "weight")


def _found(needed: DataFrame, questions: DataFrame, index: StoredIndex, avgdl: float, limit: int, config: Config) -> DataFrame:
    """question_id, chunk_id, document_id, score: at least the best ``limit`` rows of a positive sum over the needed blocks.

    ``needed`` (question_id, term, level, weight) is settled. Where it may travel, a block is read and a posting moves
    once, however many questions need it: what a chunk holds of the needed blocks comes together in one row, which is
    scored against all questions where it lies. Beyond the bound, every question meets the postings by term.
    """
    scoped = "scope" in questions.columns
    if not keyword._small(needed, questions if scoped else None, config):
        sums = _sums(needed, questions, index, F.lit(avgdl), config).where("score > 0")
        return sums.withColumn("score", F.round("score", keyword.SCORE_DIGITS))
    rows = [(r["question_id"], f"{r['level']} {r['term']}", r["weight"]) for r in needed.collect() if r["question_id"] is not None]
    scopes = [tuple(r) for r in questions.select("question_id", "scope").collect()] if scoped else []
    places = F.broadcast(needed.select(_bucket(F.col("term")).alias("bucket"), "term", "level").distinct())
    wanted = [r["bucket"] for r in places.select("bucket").distinct().collect()]
    blocks = index.blocks.select("bucket", "term", "level", "segment", "postings").where(F.col("bucket").isin(wanted))
    name = F.concat_ws(" ", F.col("level").cast("string"), "term").alias("term")
    postings = blocks.join(places, ["bucket", "term", "level"]).select("segment", name, F.explode("postings").alias("p"))
    # By chunk alone, which serves the tombstones' join and the gathering.
    rows_of_chunks = index.live(postings.select("segment", "term", "p.*").repartition("chunk_id"))
    gathered = rows_of_chunks.groupBy("chunk_id", "document_id").agg(
        F.collect_list(F.struct("term", _gain(F.col("tf"), F.col("dl"), F.lit(avgdl), config).alias("gain"))).alias("gains"))
    return keyword._scored_in_place(
        gathered, keyword._Asked(rows, scopes, avgdl), questions.schema["question_id"].dataType, limit, config)


def _sums(needed: DataFrame, questions: DataFrame, index: StoredIndex, avgdl: Column, config: Config) -> DataFrame:
    """Sums over the needed blocks (question_id, term, level, weight) per question and live chunk in its scope."""
    scoped = "scope" in questions.columns
    if scoped:
        needed = needed.join(questions.select("question_id", "scope"), "question_id")
    blocks = index.blocks.select("term", "level", "segment", "postings")
    sizes = blocks.groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    keyed = needed.withColumnRenamed("level", "_level")
    matched = join_hot_keys(blocks, keyed, "term", sizes, "rows", "level", config.hot_rows // BLOCK).where("level = _level")
    carried = ["question_id", "weight", "segment", *(["scope"] if scoped else [])]
    rows = matched.select(*carried, F.explode("postings").alias("p")).select(*carried, "p.*")
    if scoped:
        rows = rows.where(keyword.in_scope(F.col("scope"), F.col("document_id")))
    return index.live(rows).groupBy("question_id", "chunk_id", "document_id").agg(
        F.sum(F.col("weight") * _gain(F.col("tf"), F.col("dl"), avgdl, config)).alias("score"))


def search(
    questions: DataFrame, index: StoredIndex, top: int | None = None, config: Config = DEFAULT, question: str = "question",
) -> DataFrame:
    """The rows of ``keyword.keyword_search`` over all live chunks, from the blocks that each question needs."""
    limit = top or config.top_k
    weights = settle(_weights(questions, index.statistics(config), question))
    needed = settle(_needed(questions, index, weights, limit, config))
    found = _found(needed, questions, index, _mean_length(weights), limit, config)
    return top_k(found, ["question_id"], [F.desc("score"), F.asc("chunk_id")], limit)
