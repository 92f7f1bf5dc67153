"""Documents that give different figures for the same thing; the newest upload wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions import fixed, text

NOT_DOCUMENTS = ["calculation", "library"]


def stamp_upload_times(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Attach each document's upload time, read from the documents table."""
    times = docs.select("document_id", F.col("created_at").alias("uploaded_at"))
    return hits.drop("uploaded_at").join(times, "document_id", "left")


def extract_claims(chunks: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Every "<number> <what it measures>": scope..., chunk, position, value and key.

    chunks(chunk_id, document_id, filename, content[, url][, uploaded_at]) plus scope columns.
    """
    pattern = F.lit("(?U)" + fixed.CLAIM)
    values = F.regexp_extract_all("content", pattern, F.lit(1))
    words = F.regexp_extract_all("content", pattern, F.lit(2))
    pairs = F.arrays_zip(values.alias("value"), words.alias("words"))
    usable = ~F.col("document_id").isin(NOT_DOCUMENTS)
    if "url" in chunks.columns:
        usable = usable & F.col("url").isNull()
    # Hits keep their list order; bare chunks fall back to their id.
    place = F.col("number") if "number" in chunks.columns else F.col("chunk_id")
    uploaded = F.col("uploaded_at") if "uploaded_at" in chunks.columns else F.lit(None).cast("timestamp")
    return (
        chunks.where(usable)
        .select(*(scope or []), "chunk_id", "document_id", "filename", uploaded.alias("uploaded_at"),
                place.alias("place"),
                F.posexplode(pairs).alias("position", "claim"))
        .select("*", F.col("claim.value").alias("value"), text.claim_key(F.col("claim.words")).alias("key"))
        .where(F.size("key") >= 2)
        .drop("claim")
    )


def find_conflicts(claims: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row per document in a conflict, with ``current`` marking the newest.

    A key may hold any share of the claims: the first claim per document, the counts
    and the newest document are all map-side combined aggregates, and no key is gathered.
    """
    keys = [*(scope or []), "key"]
    # One struct per document, so that both readers below share one exchange of the claims.
    first = claims.groupBy(*keys, "document_id").agg(
        F.min(F.struct("place", "position", "value", "filename", "uploaded_at")).alias("first")
    )
    # Newest first, undated last; equally dated documents keep claim order.
    age = F.coalesce(-F.unix_micros("first.uploaded_at"), F.lit(2**63 - 1))
    conflicting = first.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.min("first.value").alias("_low"), F.max("first.value").alias("_high"),
        F.min(F.struct(age.alias("age"), "first.place", "first.position", "document_id")).alias("_newest"),
    ).where("documents > 1 and _low <> _high")
    return first.join(conflicting, keys).select(
        *keys, "document_id", "documents", "first.value", "first.filename", "first.uploaded_at",
        F.struct("first.place", "first.position").alias("place"),
        (F.col("document_id") == F.col("_newest.document_id")).alias("current"),
    )


def conflict_notes(conflicts: DataFrame, scope: list[str]) -> DataFrame:
    """One sentence per conflict of a bounded scope, such as one question's hits."""
    dated = F.when(
        F.col("uploaded_at").isNotNull(),
        F.concat(F.lit(" (uploaded "), F.date_format("uploaded_at", "yyyy-MM-dd"), F.lit(")")),
    ).otherwise("")
    says = F.concat(F.col("filename"), F.lit(" says "), F.col("value"), dated)
    newest_first = Window.partitionBy(*scope, "key").orderBy(
        F.desc_nulls_last("uploaded_at"), F.asc("place")
    )
    numbered = conflicts.withColumn("_n", F.row_number().over(newest_first)).withColumn("_says", says)
    lines = numbered.groupBy(*scope, "key").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_says"))).alias("_lines")
    )
    spoken = F.transform("_lines", lambda r: r._says)
    return lines.select(
        *scope, F.array_join("key", " ").alias("subject"),
        F.concat(
            F.array_join("key", " "), F.lit(": "), F.element_at(spoken, 1), F.lit(" — most recent. Previously "),
            F.array_join(F.slice(spoken, 2, F.size(spoken) - 1), "; "), F.lit("."),
        ).alias("note"),
    )


def context_notes(conflicts: DataFrame, scope: list[str]) -> DataFrame:
    """What goes above the sources: one note per question that has conflicts, in the order its sources raise them.

    A scope without conflicts has no row. ``scope`` names at least one column: a note over all rows at once would
    gather them.
    """
    if not scope:
        raise ValueError("context_notes needs a scope, such as question_id")
    raised = conflicts.groupBy(*scope, "key").agg(F.min("place").alias("_raised"))
    lines = conflict_notes(conflicts, scope).join(
        raised.withColumn("subject", F.array_join("key", " ")).drop("key"), [*scope, "subject"])
    ordered = F.array_sort(F.collect_list(F.struct("_raised", "subject", F.concat(F.lit("- "), "note").alias("line"))))
    return lines.groupBy(*scope).agg(ordered.alias("_lines")).select(
        *scope, F.size("_lines").alias("conflicts"),
        F.concat(F.lit(fixed.CONFLICT_LEAD + "\n"), F.array_join(F.transform("_lines", lambda r: r.line), "\n")).alias("note"),
    )
