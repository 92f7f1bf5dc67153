"""Building blocks that keep a plan whole when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.session import settle


# Above this many shuffle partitions, a top-k is merged in two steps of this width.
WIDE_PARTITIONS = 1000
MERGE_WIDTH = 256


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank: str = "rank"
) -> DataFrame:
    """First k rows per key.

    A literal bound lets Spark prune each partition to k rows per key before the shuffle
    (WindowGroupLimit), so a hot key never gathers in one task. On a wide cluster even
    k rows from every partition are many, so groups of partitions are merged first.
    """
    if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > WIDE_PARTITIONS:
        df = df.withColumn("_part", F.spark_partition_id() % MERGE_WIDTH)
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k).drop("_part", "_n")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows cut into ranges of ``order`` of about equal size: _range names one, _place counts inside it from 0.

    However many rows a key has, they lie in as many ranges as they fill; only rows equal in all of ``order`` stay
    together. Settled, as counts per range and rows must come from the same cut.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # A range's number and the place in it, given out as the rows leave their sort.
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    return settle(placed.withColumn("_range", F.shiftright("_at", 33).cast("int")).withColumn(
        "_place", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"))


def _beside(rows: DataFrame, per_range: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their key has in their range; null keys meet too."""
    names = [*keys, "_range"]
    other = per_range.withColumnsRenamed({n: f"_of_{i}" for i, n in enumerate(names)})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_of_{i}")) for i, n in enumerate(names)])
    return rows.join(other, same)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """row_number per key for keys of any size; a null key is a key.

    Rows lie in ranges of (keys, order). A row's number is its place in the range, less that of the key's first row
    there, plus the key's rows in earlier ranges; only counts per key and range meet in one task.
    """
    ranged = in_ranges(df, [F.col(c).asc_nulls_first() for c in [*keys, *order]])
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return _beside(ranged, shift, keys).select(*df.columns, (F.col("_place") + F.col("_shift")).alias(name))


def with_halo(df: DataFrame, number: str, width: int, block: int) -> DataFrame:
    """Blocks of consecutive numbers, each led by the last ``width`` rows before it.

    A frame that looks back at most ``width`` rows can then run per (key, _block).
    Rows flagged ``_halo`` are context only. ``number`` starts at 0.
    """
    own = F.floor(F.col(number) / block)
    lends = F.col(number) % block >= block - width
    copies = F.when(lends, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        df.withColumn("_copy", F.explode(copies))
        .withColumn("_block", own + F.col("_copy"))
        .withColumn("_halo", F.col("_copy") == 1)
        .drop("_copy")
    )


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Last non-null value at or before each row, for keys of any size (an as-of join); a null key is a key.

    Inside a key's rows of one range a window carries the value; over ranges the last value of each is carried. What
    ``order`` ends with should tell rows of one moment apart, so that many of them can lie in several ranges.
    """
    ranged = in_ranges(df.withColumn("_value", value), [F.col(c).asc_nulls_first() for c in [*keys, *order]])
    present = F.when(F.col("_value").isNotNull(), F.col("_place"))
    ends = ranged.groupBy(*keys, "_range").agg(F.max_by("_value", present).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select(*keys, "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_brought"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    carried = ranged.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    return _beside(carried, brought, keys).select(*df.columns, F.coalesce("_inside", "_brought").alias(name))


# A key above this share of the rows is split; at most that many keys can be.
HOT_SHARE = 4096


def join_hot_keys(
    left: DataFrame, right: DataFrame, key: str, counts: DataFrame, n: str, spread_by: str, least: int
) -> DataFrame:
    """Inner join where one key may hold a large part of the left rows.

    counts(key, n) gives the left rows per key. Keys above 1/4096 of all rows (and above
    ``least`` rows) are split by the hash of ``spread_by``, their right rows repeated per
    split. No more than 4096 keys can be that large, so their list is safe to broadcast.
    """
    total = counts.agg(F.sum(n).alias("total")).scalar()
    hot = F.broadcast(
        counts.where(F.col(n) > F.greatest(F.lit(least), total / HOT_SHARE))
        .select(key, F.ceil(F.col(n) * HOT_SHARE / total).cast("int").alias("_splits"))
    )
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_splits")).cast("int"), F.lit(0))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)
    split = left.join(hot, key, "left").withColumn("_salt", salt).drop("_splits")
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_splits")
    return split.join(repeated, [key, "_salt"]).drop("_salt")


def only(df: DataFrame, column: str) -> Column:
    """A one-row aggregate as a scalar subquery, in place of a join with one row."""
    return df.select(column).scalar()


#: Text of one step of a task, in bytes.
STEP_BYTES = 1 << 20


def in_steps(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches with about STEP_BYTES of text each (or one longer row), so that memory follows a step."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + STEP_BYTES, "right")))
            yield batch.slice(low, high - low)
            low = high
