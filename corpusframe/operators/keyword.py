"""Inverted index and Okapi BM25 for a batch of questions.

Chunks are (chunk_id, document_id, content); questions are (question_id, question) with an
optional ``scope`` array of document ids. Inverse document frequency is corpus-wide, so a
scope narrows the postings but never the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import text
from corpusframe.operators.scale import join_hot_keys, only, top_k
from corpusframe.session import ship

SCORE_DIGITS = 6


@dataclass(frozen=True)
class KeywordIndex:
    tokens: DataFrame  # chunk_id, document_id, tokens array<string>, or terms array<struct<term, tf>> with dl
    terms: DataFrame   # term, df, idf
    corpus: DataFrame  # n_chunks, avgdl (one row)

    @property
    def counts(self) -> DataFrame:
        return self.tokens if "terms" in self.tokens.columns else runs_of(self.tokens)

    @property
    def postings(self) -> DataFrame:
        return exploded(self.counts)


def cut(chunks: DataFrame) -> DataFrame:
    """The tokens of every chunk, where it lies; a chunk without any has an empty list."""
    return chunks.select("chunk_id", "document_id", text.tokens(F.col("content")).alias("tokens"))


def runs_of(tokens: DataFrame) -> DataFrame:
    """Term frequencies of every chunk, as run lengths of its sorted tokens inside the row. Nothing moves."""
    ordered = tokens.select("chunk_id", "document_id", F.sort_array("tokens").alias("tokens"))
    sized = ordered.select("*", F.size("tokens").alias("dl"))
    places = F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.col("dl") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)))
    runs = F.transform("starts", lambda i, at: F.struct(
        F.get("tokens", i).alias("term"), (F.coalesce(F.get("starts", at + 1), F.col("dl")) - i).alias("tf")
    ))
    return sized.select("*", starts.alias("starts")).select("chunk_id", "document_id", "dl", runs.alias("terms"))


def counted(chunks: DataFrame) -> DataFrame:
    return runs_of(cut(chunks))


def exploded(counts: DataFrame) -> DataFrame:
    """term, chunk_id, document_id, tf, dl: one row per distinct term of a chunk."""
    # Not a plain explode: Spark would first filter by the size of the array, working the whole expression out below.
    return counts.select("chunk_id", "document_id", "dl", F.explode_outer("terms").alias("run")).select(
        F.col("run.term").alias("term"), "chunk_id", "document_id", F.col("run.tf").alias("tf"), "dl").where("term is not null")


def postings_of(chunks: DataFrame) -> DataFrame:
    return exploded(counted(chunks))


def frequencies_of(tokens: DataFrame) -> DataFrame:
    """term, df and length, combined map-side; the lengths of all terms add up to that of the corpus.

    A chunk's own length is added to the first of its terms. Every term occurs, so the condition drops nothing; it
    keeps both counts in the plan of every reader, which is what lets them all share one exchange.
    """
    if "terms" in tokens.columns:
        kinds, dl = F.col("terms.term"), F.col("dl")
    else:
        kinds, dl = F.array_distinct("tokens"), F.size("tokens")
    rows = tokens.select(kinds.alias("kinds"), dl.alias("dl")).select("dl", F.posexplode_outer("kinds").alias("at", "term"))
    return rows.where("term is not null").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("at") == 0, F.col("dl")).otherwise(0)).alias("length")
    ).where("df > 0 and length >= 0")


def corpus_of(chunks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Chunks without a token count too, but hold no posting."""
    n = only(chunks.agg(F.count(F.lit(1)).alias("n_chunks")), "n_chunks")
    return frequencies.agg(F.sum("length").alias("_tokens")).select(
        n.alias("n_chunks"), (F.col("_tokens") / n).alias("avgdl")
    )


def terms_of(frequencies: DataFrame, corpus: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Inverse document frequency, negative values floored at epsilon x mean."""
    n = only(corpus, "n_chunks")
    raw = frequencies.withColumn("_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = only(raw.agg(F.avg("_idf").alias("mean_idf")), "mean_idf")
    return raw.select(
        "term", "df",
        F.when(F.col("_idf") < 0, config.bm25_epsilon * mean).otherwise(F.col("_idf")).alias("idf"),
    )


def _index(tokens: DataFrame, chunks: DataFrame, config: Config) -> KeywordIndex:
    frequencies = frequencies_of(tokens)
    corpus = corpus_of(chunks, frequencies)
    return KeywordIndex(tokens, terms_of(frequencies, corpus, config), corpus)


def build_index(chunks: DataFrame, config: Config = DEFAULT) -> KeywordIndex:
    """An index for this session: the text is cut where it lies, and only term counts move. See segments.py for a stored one."""
    return _index(cut(chunks), chunks, config)


def refresh_index(index: KeywordIndex, chunks: DataFrame, config: Config = DEFAULT) -> KeywordIndex:
    """Tokenise only chunks the index does not hold; drop those that vanished."""
    known, live = index.tokens.select("chunk_id"), chunks.select("chunk_id")
    fresh = chunks.join(known, "chunk_id", "left_anti")
    counts = index.counts.join(live, "chunk_id", "left_semi").unionByName(counted(fresh))
    return _index(counts, chunks, config)


def index_changes(index: KeywordIndex, chunks: DataFrame) -> DataFrame:
    """chunk_id, change: what a refresh would add and remove. A chunk without a token is known like any other."""
    known, live = index.tokens.select("chunk_id"), chunks.select("chunk_id")
    return live.join(known, "chunk_id", "left_anti").withColumn("change", F.lit("added")).unionByName(
        known.join(live, "chunk_id", "left_anti").withColumn("change", F.lit("removed"))
    )


def question_terms(questions: DataFrame, question: str = "question") -> DataFrame:
    """(question_id, term, qtf): a repeated query token counts each time."""
    return (
        questions.select("question_id", F.explode(text.tokens(F.col(question))).alias("term"))
        .groupBy("question_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def scope_filter(df: DataFrame, document_ids: list[str] | None) -> DataFrame:
    """Rows of the given documents; null or empty is the whole library."""
    return df.where(F.col("document_id").isin(sorted(set(document_ids)))) if document_ids else df


def in_scope(scope: Column, document_id: Column) -> Column:
    """A null or empty scope is the whole library."""
    return scope.isNull() | (F.size(scope) == 0) | F.array_contains(scope, document_id)


def _small(asked: DataFrame, scopes: DataFrame | None, config: Config) -> bool:
    """Whether the query terms (and scope lists, repeated per term) are within the bound."""
    rows = asked.limit(config.resident_terms + 1).count()
    if rows > config.resident_terms:
        return False
    if scopes is None:
        return True
    widest = scopes.agg(F.coalesce(F.max(F.size("scope")), F.lit(0)).alias("w")).first()["w"]
    return rows * max(widest, 1) <= config.resident_values


def keyword_scores(
    questions: DataFrame, index: KeywordIndex, config: Config = DEFAULT, question: str = "question"
) -> DataFrame:
    """(question_id, chunk_id, document_id, score) of every chunk sharing a term."""
    return _sums(questions, index, config, question).withColumn("score", F.round("score", SCORE_DIGITS))


def _sums(questions: DataFrame, index: KeywordIndex, config: Config, question: str) -> DataFrame:
    """The scores before they are rounded."""
    asked = question_terms(questions, question)
    weights = asked.join(index.terms, "term").select(
        "question_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")
    )
    scoped = "scope" in questions.columns
    if scoped:
        weights = weights.join(questions.select("question_id", "scope"), "question_id")
    if _small(asked, questions if scoped else None, config):
        # Few enough to travel: postings stay where their chunk is, and a chunk's sums are complete there.
        matched = index.postings.join(F.broadcast(weights), "term")
    else:
        # Both sides move by term; a term found in a large part of the chunks is split.
        matched = join_hot_keys(
            index.postings, weights, "term", index.terms, "df", "chunk_id", config.hot_rows
        )
    if scoped:
        matched = matched.where(in_scope(F.col("scope"), F.col("document_id")))
    k1, b = config.bm25_k1, config.bm25_b
    avgdl = only(index.corpus, "avgdl")
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return matched.groupBy("question_id", "chunk_id", "document_id").agg(
        F.sum(F.col("weight") * gain).alias("score")
    )


def keyword_search(
    questions: DataFrame, index: KeywordIndex, top: int | None = None, config: Config = DEFAULT,
    question: str = "question",
) -> DataFrame:
    """Best chunks per question: (question_id, chunk_id, document_id, score, rank)."""
    limit = top or config.top_k
    resident = _resident(questions, index, config, question)
    if resident is not None:
        scores = _scored_in_place(index.tokens, resident, questions.schema["question_id"].dataType, limit, config)
    else:
        # A true match may be smaller than the last digit kept.
        matched = _sums(questions, index, config, question).where("score > 0")
        scores = matched.withColumn("score", F.round("score", SCORE_DIGITS))
    return top_k(scores, ["question_id"], [F.desc("score"), F.asc("chunk_id")], limit)


class _Asked:
    """The weights of a bounded set of questions by term, and the documents that each may see."""

    def __init__(self, weights: list[tuple], scopes: list[tuple], avgdl: float) -> None:
        self.avgdl = avgdl
        self.ids = sorted({row[0] for row in weights})
        place = {q: i for i, q in enumerate(self.ids)}
        self.terms = pa.array(sorted({row[1] for row in weights}), pa.string())
        number = {t: i for i, t in enumerate(self.terms.to_pylist())}
        codes = np.array([number[row[1]] for row in weights], np.int64)
        order = np.argsort(codes, kind="stable")
        self.question = np.array([place[row[0]] for row in weights], np.int64)[order]
        self.weight = np.array([row[2] for row in weights], np.float64)[order]
        self.first = np.searchsorted(codes[order], np.arange(len(self.terms) + 1))
        self.free = np.ones(len(self.ids), bool)
        self.seen: dict[str, list[int]] = {}
        for q, documents in scopes:
            if documents and q in place:
                self.free[place[q]] = False
                for document in documents:
                    self.seen.setdefault(document, []).append(place[q])

    def allowed(self, documents: pa.Array) -> np.ndarray | None:
        if self.free.all():
            return None
        names = documents.dictionary_encode()
        table = np.repeat(self.free[None, :], len(names.dictionary) + 1, 0)
        for i, name in enumerate(names.dictionary.to_pylist()):
            table[i, self.seen.get(name, [])] = True
        return table[names.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _resident(questions: DataFrame, index: KeywordIndex, config: Config, question: str) -> _Asked | None:
    """Weights of the questions where they are within the bounds, which are checked before a row is fetched."""
    asked = question_terms(questions, question)
    scoped = "scope" in questions.columns
    if not _small(asked, questions if scoped else None, config):
        return None
    weights = asked.join(index.terms, "term").select(
        "question_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), only(index.corpus, "avgdl").alias("avgdl"))
    rows = list(zip(*[column.to_pylist() for column in weights.toArrow().columns])) or []
    scopes = [tuple(r) for r in questions.select("question_id", "scope").collect()] if scoped else []
    kept = [row for row in rows if row[0] is not None]
    return _Asked([row[:3] for row in kept], scopes, float(kept[0][3] or 0.0) if kept else 0.0)


#: Scores that one step of a task holds, tokens of a step, and rows kept back before they are cut to the best ones.
_CELLS, _TOKENS, _WAITING = 1 << 20, 1 << 20, 1 << 16


def _steps(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about _TOKENS list values."""
    ends = batch.column(2).offsets.to_numpy()
    low = 0
    while low < batch.num_rows:
        high = min(low + rows, int(np.searchsorted(ends, ends[low] + _TOKENS, "right")) - 1)
        high = min(max(high, low + 1), batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def _matched(batch: pa.RecordBatch, asked: _Asked, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, gain) of every query term in the rows of a batch: from its tokens, its counts or stored gains."""
    lists = batch.column(2)
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), sizes)
    flat = lists.flatten()
    counted_ = pa.types.is_struct(flat.type)
    codes = pc.index_in(flat.field("term") if counted_ else flat, asked.terms)
    known = pc.is_valid(codes).to_numpy(zero_copy_only=False)
    row, term = row[known], codes.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
    if batch.schema.names[2] == "gains":
        return row, term, flat.field("gain").to_numpy(zero_copy_only=False)[known]
    if counted_:
        tf, length = flat.field("tf").to_numpy(zero_copy_only=False)[known], batch.column(3).to_numpy()
    else:
        # Equal terms of a row next to each other: their number is the term frequency.
        both, tf = np.unique(row * len(asked.terms) + term, return_counts=True)
        row, term, length = both // max(len(asked.terms), 1), both % max(len(asked.terms), 1), sizes
    k1, b = config.bm25_k1, config.bm25_b
    return row, term, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / asked.avgdl))


def _scored_in_place(tokens: DataFrame, asked: _Asked, kind: T.DataType, limit: int, config: Config) -> DataFrame:
    """Scores of the best rows of every task, worked out where the chunk lies; k rows per question move.

    A step of chunks makes a matrix of scores (chunks by questions) of bounded size at a time. Of each step only the rows
    that can be among a question's best are looked at by id, and ids stay Arrow columns until a row leaves the task.
    """
    spark = tokens.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(asked)
    held = next(c for c in ("gains", "terms", "tokens") if c in tokens.columns)
    source = tokens.select(F.col("chunk_id").cast("string"), F.col("document_id").cast("string"), held, *(["dl"] if held == "terms" else []))
    out = T.StructType([
        T.StructField("question_id", kind), T.StructField("chunk_id", T.StringType()),
        T.StructField("document_id", T.StringType()), T.StructField("score", T.DoubleType())])

    def best(parts: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(parts).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
        q = rows.column("q").to_numpy()
        return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < limit))

    def score(batches):
        asked = shared.value
        width = len(asked.ids)
        bound, parts, waiting = np.full(width, -np.inf), [], 0
        for batch in (step for whole in batches for step in _steps(whole, max(1, _CELLS // width))) if width else ():
            row, term, gain = _matched(batch, asked, config)
            fan = asked.first[term + 1] - asked.first[term]
            at = np.repeat(asked.first[term] - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan) + np.arange(fan.sum())
            cell = np.repeat(row, fan) * width + asked.question[at]
            sums = np.bincount(cell, asked.weight[at] * np.repeat(gain, fan), batch.num_rows * width).reshape(-1, width)
            allowed = asked.allowed(batch.column(1))
            rounded = np.where((sums > 0) if allowed is None else (sums > 0) & allowed, np.round(sums, SCORE_DIGITS) + 0.0, -np.inf)
            if len(rounded) > limit:
                # The step's own k-th best scores: what is below them is not among the best; equal ones stay.
                bound = np.maximum(bound, np.partition(rounded, len(rounded) - limit, axis=0)[len(rounded) - limit])
            chunk, q = np.nonzero((rounded >= bound[None, :]) & (rounded > -np.inf))
            # Many equal scores are cut by id in parts, so that none of them holds a whole step.
            for low in range(0, len(chunk), _WAITING):
                take = pa.array(chunk[low:low + _WAITING])
                parts.append(pa.table({
                    "q": q[low:low + _WAITING], "score": rounded[chunk[low:low + _WAITING], q[low:low + _WAITING]],
                    "chunk_id": batch.column(0).take(take), "document_id": batch.column(1).take(take)}))
                waiting += len(take)
                if waiting > _WAITING:
                    parts = [best(parts)]
                    waiting = 0
                    at_q = parts[0].column("q").to_numpy()
                    last = np.flatnonzero(np.arange(len(at_q)) - np.searchsorted(at_q, at_q) == limit - 1)
                    bound[at_q[last]] = np.maximum(bound[at_q[last]], parts[0].column("score").to_numpy()[last])
        if parts:
            rows = best(parts)
            yield pa.RecordBatch.from_arrays([
                pa.array([asked.ids[i] for i in rows.column("q").to_pylist()]).cast(types[0]),
                *[rows.column(name).combine_chunks() for name in ("chunk_id", "document_id", "score")]], names=out.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(out).types
    return source.mapInArrow(score, out)
