"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a share of all words by its weight, at most ``cap`` times what it has. Its documents get the whole
copies that share allows each of them; what is left is a sample of one more copy: documents stand in the order of
random odds over inclusion odds, and the sample is the part of that order whose words come nearest to what is left.

The order is cut per source without bringing a source together: its words are added up in BINS steps of the order
(map-side first), and only documents of one step are sorted with each other. A decision is then a comparison of a
document's own place with its source's last taken place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import settle

WEIGHTS = (5, 2, 1)
CAP = 3
SPACE = r"\x20\x09-\x0D"
#: A word with the white space around it. It gives nothing back, so a text is read once.
WORD = rf"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+"
#: Steps the order of a source is cut into.
BINS = 4096
SALT = "mix"
#: Rows of the table of sources that may travel to all tasks (about 100 bytes each).
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """One mark per word is left of a text and counted; ``regexp_count`` would lay out an array of all its words first."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def _uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the id: 52 bits of a digest, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, mean_size, target from rows (source, size).

    One row per source is sorted in one place; documents are only added up. Shares above the cap stop there, the
    excess going to the others by weight: with sources in the order of cap size over weight, the level is the first
    that its own source bears.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("filled"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("bound", F.col("source_size") * cap).withColumn("ratio", F.col("bound") / F.col("weight"))
    per = per.withColumn("level", (
        F.sum("source_size").over(everything)
        - F.sum("bound").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("bound")
    ) / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    return per.withColumn("level", level).select(
        "source", "source_size", (F.col("source_size") / F.greatest("filled", F.lit(1))).alias("mean_size"),
        F.least(F.col("level") * F.col("weight"), F.col("bound").cast("double")).alias("target"))


def _place() -> Column:
    """Random odds over the part of the inclusion odds that differs within a source.

    A document's inclusion odds are its source's (left words to words) times the root of its size over the mean:
    longer documents stand further in front, so that fewer and likelier ones close the gap.
    """
    u = F.col("u")
    # Without words there is no place: nothing of such a document can be taken.
    return F.try_divide(u / (1 - u), F.sqrt(F.try_divide(F.col("size"), F.col("mean_size"))))


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, mean_size, target, whole copies of each document, last taken place.

    ``sizes``: (doc_id, source, size). ``last`` is null where no document gets one more copy.
    """
    goals = targets(sizes, weights, cap)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("left_words", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = _shared(settle(goals))
    placed = (
        sizes.where(F.col("size") > 0).join(goals, sizes["source"].eqNullSafe(goals["source"])).drop(goals["source"])
        .withColumn("u", _uniform(F.col("doc_id"))).withColumn("place", _place())
        .withColumn("bin", F.floor(F.col("place") / (1 + F.col("place")) * BINS))
        .select("source", "doc_id", "size", "place", "bin", "left_words")
    )
    upto = Window.partitionBy("source").orderBy("bin")
    cuts = (
        placed.groupBy("source", "bin", "left_words").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
        .where((F.col("before") <= F.col("left_words")) & (F.col("upto") > F.col("left_words")))
        .select("source", F.col("bin").alias("cut"), "before")
    )
    cuts = _shared(settle(cuts))
    inside = placed.join(cuts, placed["source"].eqNullSafe(cuts["source"]) & (F.col("bin") == F.col("cut"))).drop(cuts["source"])
    # Documents of one step: equal places stand together and are taken together.
    order = Window.partitionBy("source").orderBy("place")
    taken = inside.withColumn("upto", F.sum("size").over(order) + F.col("before")).withColumn("half", F.sum("size").over(Window.partitionBy("source", "place")) / 2)
    lasts = taken.where(F.col("upto") - F.col("half") <= F.col("left_words")).groupBy("source").agg(F.max("place").alias("last"))
    whole_bins = cuts.select("source", (F.col("cut") / F.lit(float(BINS))).alias("edge"))
    lasts, whole_bins = lasts.withColumnRenamed("source", "s1"), whole_bins.withColumnRenamed("source", "s2")
    return (
        goals.join(lasts, F.col("source").eqNullSafe(F.col("s1")), "left").join(whole_bins, F.col("source").eqNullSafe(F.col("s2")), "left")
        .select("source", "source_size", "mean_size", "target", "whole", "last", F.col("edge"))
    )


def _shared(sources: DataFrame) -> DataFrame:
    """A table with one row per source travels to all tasks only while it is small."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def with_copies(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Add source_size, target and copies to rows that have doc_id, source and size."""
    own = docs.select(*[c for c in docs.columns if c not in ("source_size", "mean_size", "target", "whole", "last", "edge", "u", "place", "copies")])
    limits = limits.withColumnRenamed("source", "limit_source")
    joined = own.join(limits, F.col("source").eqNullSafe(F.col("limit_source"))).withColumn("u", _uniform(F.col("doc_id"))).withColumn("place", _place())
    step = F.floor(F.col("place") / (1 + F.col("place")) * BINS)
    more = (F.col("size") > 0) & ((step < F.col("edge") * BINS) | (F.col("place") <= F.col("last")))
    return joined.select(*own.columns, "source_size", "target", (F.col("whole") + F.coalesce(more.cast("long"), F.lit(0))).alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document.

    Null and empty texts have size 0 and nothing is taken; a null source is a source of its own, last in order.
    Rows with one id are taken alike, also where the whole row repeats. A source without words has target 0. An
    empty table gives an empty one.
    """
    sizes = settle(sized(docs))
    limits = _shared(settle(thresholds(sizes, weights, cap)))
    return with_copies(sizes, limits).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    limits = _shared(settle(thresholds(settle(sized(docs)), weights, cap)))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    # Not a filter on the copies, nor a plain explode, which brings one: it would count the words of every text again.
    again = with_copies(rows, limits).select("row", F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return again.where("copy is not null").select("row.*")


#: The same rows in DuckDB.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS filled FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight, source_size * 3 AS bound FROM per),
levels AS (
  SELECT *, bound / weight AS ratio,
    (sum(source_size) OVER () - sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) + bound)
      / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size, source_size / greatest(filled, 1) AS mean_size,
    least((SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, CAST(bound AS DOUBLE)) AS target
  FROM levels),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
drawn AS (
  SELECT s.doc_id, s.size, g.*, target - whole * source_size AS left_words,
    (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM sizes s JOIN shares g ON s.source IS NOT DISTINCT FROM g.source),
placed AS (
  SELECT *, CASE WHEN size > 0 THEN (u / (1 - u)) / sqrt(size / mean_size) END AS place FROM drawn),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place NULLS LAST) - sum(size) OVER (PARTITION BY source, place) / 2 AS reached FROM placed)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN size > 0 AND reached <= left_words THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
