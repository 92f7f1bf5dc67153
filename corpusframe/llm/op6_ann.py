"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is padded with zeros, rotated, and stored as the signs of its coordinates (packed bits, four per component),
its length, and how far its signs' direction is from its own. From these and a rotated query, an inner product is
estimated with an error bound that holds with high probability; the longer the code, the narrower the bound. The
candidates with the best estimates are scored exactly, the k-th best of them is a floor under the answer, and only vectors
whose upper bound reaches that floor are scored as well.

Queries come in blocks of bounded bytes, and so does what they are compared with; each pair of blocks is one unit of
work and hands on k rows per query. So codes of all vectors meet all queries: what the codes save is the exact work.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import settle

K = 20
#: Bytes of the vectors of one block of queries and of one block of indexed vectors.
QUERY_BYTES, INDEX_BYTES = 1 << 18, 1 << 22
#: Bits of a code per component of a vector.
BITS = 4
#: Standard deviations of the estimate's error that a bound allows for: a vector at the floor is missed once in 40 times.
SIGMAS = 2.0
#: Candidates scored for the floor, in multiples of k.
FIRST = 3
SEED = 6


@lru_cache(maxsize=4)
def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """(BITS * width, width): what a random rotation does to a vector padded with zeros; the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(BITS * width, width)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, the vectors' lengths, and the cosines between vectors and their signs."""
    turned = vectors @ rotation(vectors.shape[1]).T
    lengths = np.linalg.norm(vectors, axis=1)
    cosines = np.abs(turned).sum(1) / (np.sqrt(turned.shape[1]) * np.maximum(lengths, 1e-300))
    return np.packbits(turned > 0, axis=1), lengths, cosines


def estimate(queries: np.ndarray, signs: np.ndarray, lengths: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries x vectors) estimated inner products, and the error bound of each for a query of length one."""
    bits = signs.shape[1]
    raw = (queries @ rotation(queries.shape[1]).T).astype(np.float32) @ signs.T
    cosines = np.maximum(cosines, 1e-12)
    spread = np.sqrt(np.maximum(1 - cosines**2, 0)) / cosines / np.sqrt(max(bits - 1, 1))
    scale = (lengths / (np.sqrt(bits) * cosines)).astype(np.float32)
    return raw * scale, (lengths * (SIGMAS * spread + 1e-5)).astype(np.float32)


def exactly(queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for start in range(0, len(rows), 1 << 14):
        part = slice(start, start + (1 << 14))
        out[part] = (queries[rows[part]] * vectors[columns[part]]).sum(1)
    return out


def search_block(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, code: tuple, k: int = K):
    """(query row, id, exact inner product) of each query's k best in one block; ``own``: ids that a query skips.

    ``code``: signs as numbers, lengths, cosines. Also returns how many pairs were scored exactly.
    """
    near, bound = estimate(queries, *code)
    near[own[:, None] == ids[None, :]] = -np.inf
    reach = np.linalg.norm(queries, axis=1).astype(np.float32)
    take = min(FIRST * k, len(ids))
    first = np.argpartition(near, len(ids) - take, axis=1)[:, len(ids) - take :]
    rows = np.repeat(np.arange(len(queries)), take)
    exact = exactly(queries, vectors, rows, first.ravel()).reshape(len(queries), take)
    exact[np.isneginf(np.take_along_axis(near, first, 1))] = -np.inf
    # The k-th best of what is scored already: nothing below it can be among the k best.
    floor = np.partition(exact, take - k, axis=1)[:, take - k] if take >= k else np.full(len(queries), -np.inf)
    upper = near + reach[:, None] * bound[None, :]
    np.put_along_axis(upper, first, -np.inf, 1)
    more_rows, more = np.nonzero((upper >= floor[:, None]) & (upper > -np.inf))
    rows, columns = np.concatenate([rows, more_rows]), np.concatenate([first.ravel(), more])
    exact = np.concatenate([exact.ravel(), exactly(queries, vectors, more_rows, more)])
    scored, keep = len(rows), exact > -np.inf
    rows, columns, exact = rows[keep], columns[keep], exact[keep]
    order = np.lexsort((ids[columns], -exact, rows))
    rows, columns, exact = rows[order], columns[order], exact[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[best], ids[columns[best]], exact[best], scored


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that can take part: no null or non-finite part, not all zero, id not null."""
    v = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def _blocks(rows: DataFrame, size: int, columns: str):
    """One row per ``size`` bytes of vectors of one width: width, ids, vectors as bytes (and the code, for an index)."""

    def work(batches):
        held: dict = {}

        def row(width):
            ids, parts = held.pop(width)
            vectors = np.ascontiguousarray(np.stack(parts))
            code = encode(vectors) if "codes" in columns else None
            out = {"width": pa.array([width], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "vectors": [vectors.tobytes()]}
            if code:
                out |= {"codes": [code[0].tobytes()], "lengths": [code[1].tobytes()], "cosines": [code[2].tobytes()]}
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                vector = flat[ends[i] : ends[i + 1]]
                ids, parts = held.setdefault(len(vector), ([], []))
                ids.append(vec_id)
                parts.append(vector.copy())
                if len(ids) * 8 * len(vector) >= size:
                    yield row(len(vector))
        for width in list(held):
            yield row(width)

    return rows.mapInArrow(work, columns)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest vectors of its width, its own id excepted.

    Null, zero or non-finite vectors take no part, nor do null ids. Equal scores go by the smaller id. Of equal
    vectors the index keeps the k + 1 smallest ids, as no answer has room for more; a repeated row (same id and
    vector) is one candidate, while an id with different vectors is as many, its best one counting once per query.
    A repeated query row is asked once. Fewer than k candidates: all. Empty tables give none.
    """
    index = usable(vectors, id_column, vector_column).distinct()
    index = index.withColumn("copy", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("copy") <= k + 1).select("vec_id", "vector")
    asked = usable(queries, id_column, vector_column).distinct()
    stored = settle(_blocks(index, INDEX_BYTES, "width int, ids binary, vectors binary, codes binary, lengths binary, cosines binary"))
    # Block numbers, not vectors, meet first: one row per block on either side.
    parts = stored.rdd.getNumPartitions()
    numbered = stored.withColumn("part", F.spark_partition_id())
    blocks = _blocks(asked, QUERY_BYTES, "width int, ids binary, vectors binary").withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"})
    meeting = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1)))).join(numbered, ["part", "width"])

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "part"}
                width = row["width"]
                q = np.frombuffer(row["query_vectors"]).reshape(-1, width)
                q_ids = np.frombuffer(row["query_ids"], np.int64)
                v = np.frombuffer(row["vectors"]).reshape(-1, width)
                ids = np.frombuffer(row["ids"], np.int64)
                packed = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                signs = np.unpackbits(packed, axis=1, count=BITS * width).astype(np.float32) * 2 - 1
                code = (signs, np.frombuffer(row["lengths"]), np.frombuffer(row["cosines"]))
                for start in range(0, len(q), 128):
                    rows, found, score, _ = search_block(q[start : start + 128], q_ids[start : start + 128], v, ids, code, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[start + rows]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    found = meeting.mapInArrow(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
