"""Exact nearest neighbours for a batch of questions, without forming pairs as rows.

Questions that fit a checked bound travel to every task and the chunk vectors are read
once, in place, with no shuffle: each task keeps k rows per question. Beyond the bound,
questions are cut into blocks and chunk vectors into shares, and every (block, share)
meets in one bounded group. Both ways run the same scoring and give the same rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.config import DEFAULT, Config
from corpusframe.operators.scale import top_k
from corpusframe.session import settle, ship

# Rank after rounding, so equal vectors tie exactly and fall back to the chunk id.
DISTANCE_DIGITS = 9
_SLICE = 256
#: Vectors that a slice of questions meets at once, pairs worked out at once, and rows kept back before they are cut to the best ones.
_ROWS = 4096
_PAIRS = 1 << 14
_WAITING = 50_000


class _Questions:
    """A bounded set of questions, grouped by vector width, with their allow-lists."""

    def __init__(self, rows: list[tuple], metric: str) -> None:
        # rows: (question_id, vector, scope or None, sections or None, k)
        self.ids = [r[0] for r in rows]
        self.k = np.array([r[4] for r in rows], dtype=np.int64)
        self.sections = [None if r[3] is None else set(r[3]) for r in rows]
        self.metric = metric
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        widths: dict[int, list[int]] = {}
        self.scoped: dict[str, list[int]] = {}
        self.free = np.ones(len(rows), dtype=bool)
        for i, row in enumerate(rows):
            widths.setdefault(len(row[1]), []).append(i)
            if row[2]:
                self.free[i] = False
                for document in set(row[2]):
                    self.scoped.setdefault(document, []).append(i)
        for width, members in widths.items():
            matrix = np.array([np.asarray(rows[i][1], dtype=np.float64) for i in members])
            self.by_width[width] = (np.array(members), matrix.reshape(len(members), width))

    def distances(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """Distances by one product, and how far rounding can have moved each of them."""
        dot = left @ right.T
        if self.metric == "cosine":
            norms = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
            norms[norms == 0] = 1.0
            return -dot / norms, 1e-12 * left.shape[1]
        square = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :]
        return np.maximum(square - 2 * dot, 0.0), 1e-15 * left.shape[1] * square

    def within(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the pairs that may be as near as their row's bound: one product and one comparison of each."""
        if self.metric == "cosine":
            d, slack = self.distances(left, right)
            return np.nonzero(d - slack <= bound[:, None])
        square, other = (left * left).sum(1), (right * right).sum(1)
        slack = 1e-15 * left.shape[1] * (square + other.max(initial=0.0))
        product = np.column_stack([2 * left, np.full(len(left), -1.0)]) @ np.column_stack([right, other]).T
        return np.nonzero(product >= (square - bound - slack)[:, None])

    def settled(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Distances of pairs, row by row, without the cancellation of long vectors."""
        if self.metric == "cosine":
            norms = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
            norms[norms == 0] = 1.0
            return np.round(-(left * right).sum(1) / norms, DISTANCE_DIGITS) + 0.0
        return np.round(((left - right) ** 2).sum(1), DISTANCE_DIGITS) + 0.0


class _Best:
    """The k best rows per question seen so far."""

    COLUMNS = ["q", "distance", "chunk_id", "document_id", "section_id"]

    def __init__(self, questions: _Questions, bound: np.ndarray | None = None) -> None:
        """bound: distances beyond which rows are of no use to a question."""
        self.questions = questions
        self.bound = np.full(len(questions.ids), np.inf) if bound is None else bound
        self.kept = pd.DataFrame(columns=self.COLUMNS)
        self.pending: list[pd.DataFrame] = []
        self.waiting = 0

    def offer(self, members: np.ndarray, left: np.ndarray, right: np.ndarray, allowed, ids: list[pa.Array]) -> None:
        """members: question numbers of the rows of left; allowed: which pairs are in scope, or None for all of them."""
        row = col = None
        if allowed is None and np.isfinite(self.bound[members]).all():
            row, col = self.questions.within(left, right, self.bound[members] + 10.0**-DISTANCE_DIGITS)
        # Where the bounds leave few rows to a question, the nearest of this slice need not be known.
        if row is None or len(row) > int(self.questions.k[members].max()) * len(members):
            row, col = self._nearest(members, left, right, allowed)
        if not len(row):
            return
        # Only rows that may be among the best are worked out exactly and have their ids fetched.
        exact = np.concatenate([
            self.questions.settled(left[row[at:at + _PAIRS]], right[col[at:at + _PAIRS]]) for at in range(0, len(row), _PAIRS)])
        chunk, document, section = (column.take(pa.array(col)).to_numpy(zero_copy_only=False) for column in ids)
        self.pending.append(pd.DataFrame({
            "q": members[row], "distance": exact, "chunk_id": chunk, "document_id": document, "section_id": section,
        }))
        self.waiting += len(row)
        if self.waiting > _WAITING:
            self.settle()

    def _nearest(self, members: np.ndarray, left: np.ndarray, right: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray]:
        d, slack = self.questions.distances(left, right)
        if allowed is not None:
            d = np.where(allowed, d, np.inf)
        k = min(int(self.questions.k[members].max()), d.shape[1])
        high = d + slack
        nearest = np.partition(high, k - 1, axis=1)[:, k - 1]
        limit = np.minimum(nearest, self.bound[members]) + 10.0**-DISTANCE_DIGITS
        if k == self.questions.k[members].max():
            # Here lie k rows at least as near, so later slices need not offer what is farther.
            self.bound[members] = np.minimum(nearest, self.bound[members])
        return np.nonzero((d - slack <= limit[:, None]) & np.isfinite(d))

    def settle(self) -> pd.DataFrame:
        if self.pending:
            frames = [f for f in (self.kept, *self.pending) if len(f)]
            rows = pd.concat(frames, ignore_index=True).sort_values(["q", "distance", "chunk_id"])
            place = rows.groupby("q", sort=False).cumcount().to_numpy()
            number = rows["q"].to_numpy(dtype=np.int64)
            self.kept = rows[place < self.questions.k[number]]
            full = place == self.questions.k[number] - 1
            self.bound[number[full]] = np.minimum(self.bound[number[full]], rows["distance"].to_numpy(dtype=float)[full])
            self.pending, self.waiting = [], 0
        return self.kept


def _vectors(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) per vector width of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(widths)[:-1]]) if len(widths) else widths
    for width in np.unique(widths):
        rows = np.nonzero(widths == width)[0]
        if width == 0:
            continue
        if len(rows) == len(widths):
            yield rows, flat.reshape(-1, width).astype(np.float64)
        else:
            yield rows, flat[starts[rows][:, None] + np.arange(width)].astype(np.float64)


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _scan(questions: _Questions, batch, best: _Best, flagged: np.ndarray | None = None) -> None:
    """All rows of a batch against the questions, or those of them that are ``flagged``."""
    names = [_whole(batch.column(i)) for i in range(3)]
    document, section = names[1].dictionary_encode(), names[2].dictionary_encode()
    document_codes = document.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    section_codes = section.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    scoped = [(code, questions.scoped[name]) for code, name in enumerate(document.dictionary.to_pylist())
              if name in questions.scoped]
    sections = section.dictionary.to_pylist()
    for rows, right in _vectors(batch.column(3)):
        members, left = questions.by_width.get(right.shape[1], (None, None))
        if members is None:
            continue
        here = [column.take(pa.array(rows)) for column in names]

        def offer(numbers: np.ndarray, places: np.ndarray, inside=None) -> None:
            """Questions against the rows (a subset of them where ``inside`` is given)."""
            ids = here if inside is None else [column.take(pa.array(inside)) for column in here]
            vectors = right if inside is None else right[inside]
            codes = section_codes[rows] if inside is None else section_codes[rows[inside]]
            # Few vectors meet more questions at once, within the same number of pairs.
            step = max(_SLICE, _SLICE * _ROWS // max(len(vectors), 1))
            for at in range(0, len(numbers), step):
                some = numbers[at:at + step]
                for low in range(0, len(vectors), _ROWS):
                    part = slice(low, low + _ROWS)
                    best.offer(some, left[places[at:at + step]], vectors[part], _allowed(questions, some, sections, codes[part]),
                               [column[part] for column in ids])

        free = np.flatnonzero(questions.free[members] if flagged is None else questions.free[members] & flagged[members])
        offer(members[free], free)
        position = {int(number): i for i, number in enumerate(members)}
        codes = document_codes[rows]
        for code, asking in scoped:
            places = np.array([position[m] for m in asking if m in position], dtype=np.int64)
            inside = np.flatnonzero(codes == code)
            if len(places) and len(inside):
                offer(members[places], places, inside)


def _allowed(questions: _Questions, members: np.ndarray, sections: list, codes: np.ndarray) -> np.ndarray | None:
    """Pairs whose section is on the question's list: one decision per section, spread over the rows by code."""
    lists = [questions.sections[number] for number in members]
    if all(allowed is None for allowed in lists):
        return None
    table = np.array([[allowed is None or name in allowed for name in [*sections, None]] for allowed in lists])
    return table[:, codes]


def _emit(questions: _Questions, best: _Best, schema: pa.Schema) -> pa.RecordBatch:
    kept = best.settle()
    number = kept["q"].to_numpy(dtype=np.int64)
    columns = [
        [questions.ids[i] for i in number], kept["chunk_id"].tolist(), kept["document_id"].tolist(),
        kept["section_id"].tolist(), kept["distance"].tolist(), questions.k[number].tolist(),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema)], schema=schema
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _prepared(questions: DataFrame, top: int) -> DataFrame:
    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in questions.columns else F.lit(None).cast(kind)

    return questions.where(F.size("embedding") > 0).select(
        "question_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        optional("scope", "array<string>").alias("scope"),
        optional("section_scope", "array<string>").alias("section_scope"),
        F.coalesce(optional("k", "int"), F.lit(top)).cast("int").alias("k"),
    )


def _resident(asked: DataFrame, scoped: bool, config: Config) -> list[tuple] | None:
    """The questions themselves when they are within the bound, else None."""
    if scoped:
        # Allow-lists can be of any length, so the size is known before a row is fetched.
        weight = F.size("embedding") + F.greatest(F.size("scope"), F.lit(0)) + F.greatest(F.size("section_scope"), F.lit(0))
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("w")).first()
        if size["n"] > config.resident_questions or size["w"] > config.resident_values:
            return None
    table = asked.limit(config.resident_questions + 1).toArrow()
    if table.num_rows > config.resident_questions:
        return None
    rows = list(zip(*[column.to_pylist() for column in table.columns]))
    return rows if sum(len(r[1]) for r in rows) <= config.resident_values else None


def nearest(
    questions: DataFrame, chunks: DataFrame, top: int | None = None, metric: str = "l2",
    config: Config = DEFAULT,
) -> DataFrame:
    """k nearest chunks per question: (question_id, chunk_id, document_id, section_id, score, rank).

    questions(question_id, embedding[, scope][, section_scope][, k]); scope lists are
    allow-lists of document and section ids, null or empty meaning no restriction.
    ``score`` is squared L2 distance, or minus the cosine; vectors of another width
    never match. Ties fall back to the chunk id.
    """
    limit = top or config.top_k
    ship(chunks.sparkSession)
    scoped = bool({"scope", "section_scope"} & set(questions.columns))
    asked = _prepared(questions, limit)
    if scoped:
        asked = asked.persist()
    section = F.col("section_id") if "section_id" in chunks.columns else F.lit(None)
    candidates = chunks.where(F.size("embedding") > 0).select(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("document_id").cast("string").alias("document_id"),
        section.cast("string").alias("section_id"),
        "embedding",
    )
    out = T.StructType([
        asked.schema["question_id"], T.StructField("chunk_id", T.StringType()),
        T.StructField("document_id", T.StringType()), T.StructField("section_id", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("k", T.LongType()),
    ])
    schema = _arrow_schema(out)
    rows = _resident(asked, scoped, config)
    if rows is not None:
        asked.unpersist()
        resident = chunks.sparkSession.sparkContext.broadcast(_Questions(rows, metric))

        def scan(batches):
            state = resident.value
            best = _Best(state)
            for batch in batches:
                _scan(state, batch, best)
            yield _emit(state, best, schema)

        found = candidates.mapInArrow(scan, out)
    else:
        found = _blocks(settle(asked), candidates, metric, out, schema, config)
    bound = F.col("k") if "k" in questions.columns else limit
    return top_k(found, ["question_id"], [F.asc("score"), F.asc("chunk_id")], bound).drop("k")


def _blocks(asked, candidates, metric, out, schema, config) -> DataFrame:
    """Every block of questions meets every share of the vectors, each of bounded size.

    Where all questions are scoped, vectors of other documents are left out first.
    """
    if asked.where("scope is null or size(scope) = 0").isEmpty():
        wanted = asked.select(F.explode("scope").alias("document_id")).distinct()
        candidates = candidates.join(wanted, "document_id", "left_semi").select(*candidates.columns)
    def groups(rows: DataFrame, most: int) -> int:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("values")).first()
        return max(1, -(-size["n"] // most), -(-size["values"] // config.block_values))

    blocks, shares = groups(asked, config.block_questions), groups(candidates, config.block_vectors)
    left = asked.withColumn("_block", F.pmod(F.xxhash64("question_id"), F.lit(blocks))).withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>"))
    )
    right = candidates.withColumn("_share", F.pmod(F.xxhash64("chunk_id"), F.lit(shares))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    )

    def meet(some_questions: pa.Table, some_chunks: pa.Table) -> pa.Table:
        names = ["question_id", "embedding", "scope", "section_scope", "k"]
        rows = list(zip(*[some_questions.column(n).to_pylist() for n in names]))
        state = _Questions(rows, metric)
        best = _Best(state)
        if rows and some_chunks.num_rows:
            _scan(state, some_chunks.select(["chunk_id", "document_id", "section_id", "embedding"]), best)
        return pa.Table.from_batches([_emit(state, best, schema)])

    return (
        left.groupBy("_block", "_share").cogroup(right.groupBy("_block", "_share")).applyInArrow(meet, out)
    )


def within_distance(hits: DataFrame, limit: float | None) -> DataFrame:
    """Applied after the top-k, as a relevance floor; a null score is kept."""
    return hits if limit is None else hits.where(F.col("score").isNull() | (F.col("score") <= limit))


def semantic_search(
    questions: DataFrame, chunks: DataFrame, top: int | None = None, config: Config = DEFAULT
) -> DataFrame:
    return within_distance(nearest(questions, chunks, top, "l2", config), config.max_distance)
