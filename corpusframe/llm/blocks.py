"""Sums over all packs, asked for in sorted blocks.

A pack holds many keys, and wants to know something of each over all packs. As rows, a key would travel with its pack's
number, be grouped, joined back and travel again. Here a pack sends, per share of the key space, one compressed block of
sorted keys and values; a share answers each block with one value per key in the same order, so answers hold no key.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import bucket_count, small_batches, stored

#: Packs whose keys one share holds, on average: what bounds a share's memory.
PACKS_PER_SHARE = 4
ASKS = "gid long, topic int, share long, keys binary, held binary"


def share_bits(packs: int) -> int:
    """Bits of a key that name its share, for about that many packs."""
    return max(4, (packs // PACKS_PER_SHARE).bit_length())


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, laid out by the place of a byte in its number."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.compress(planes.T.tobytes(), 1)


def expand(blob: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys ascending, a place of each, and the number of every key among them.

    What is not needed any more goes at once, as keys are many: also ``keys``, unless the caller holds them.
    """
    order = np.argsort(keys)
    arranged = keys[order]
    del keys
    begins = np.ones(len(arranged), bool)
    begins[1:] = arranged[1:] != arranged[:-1]
    found = arranged[begins]
    del arranged
    kind = np.int32 if len(order) < 1 << 31 else np.int64
    number = np.empty(len(order), kind)
    number[order] = np.cumsum(begins, dtype=kind) - kind(1)
    return found, order[begins], number


def blocks(gid: int, topic: int, keys: np.ndarray, values: np.ndarray, bits: int, width: int = 64) -> Iterator[pa.RecordBatch]:
    """The blocks of one pack: ``keys`` are uint64 below 2 ** width, ascending and distinct, with a value each."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    cuts = np.append(np.searchsorted(keys, edges), len(keys))
    for share in np.flatnonzero(np.diff(cuts)).tolist():
        part = keys[cuts[share] : cuts[share + 1]]
        steps = np.diff(part, prepend=edges[share])
        yield pa.RecordBatch.from_pydict({
            "gid": pa.array([gid], pa.int64()), "topic": pa.array([topic], pa.int32()), "share": pa.array([share], pa.int64()),
            "keys": pa.array([squeeze(steps)], pa.binary()), "held": pa.array([squeeze(values[cuts[share] : cuts[share + 1]])], pa.binary())})


def answered(asks: DataFrame, bits: int, kind, combine: Callable) -> DataFrame:
    """gid, topic, share and the answer to every block, stored.

    ``combine(topic, which, values, pack)``: ``which`` numbers the distinct keys of a share from 0, ``values`` are those
    sent with them and ``pack`` tells the senders apart (ascending); it returns an array with one answer for each.
    """
    def answer(rows: list) -> Iterator[pa.RecordBatch]:
        # Steps are counted from the share's first key, which is the same for all its blocks.
        _, _, which = distinct(np.concatenate([np.cumsum(expand(r[3], np.uint64), dtype=np.uint64) for r in rows]))
        values = [expand(r[4], kind) for r in rows]
        lengths = [len(v) for v in values]
        values = np.concatenate(values)
        found = combine(rows[0][1], which, values, np.repeat(np.arange(len(rows), dtype=np.int32), lengths))
        del which, values
        for row, end, length in zip(rows, itertools.accumulate(lengths), lengths):
            yield pa.RecordBatch.from_pydict({
                "gid": pa.array([row[0]], pa.int64()), "topic": pa.array([row[1]], pa.int32()), "share": pa.array([row[2]], pa.int64()),
                "answer": pa.array([squeeze(found[end - length : end])], pa.binary())})

    def work(batches):
        rows = []
        for batch in batches:
            columns = [batch.column(c) for c in ("gid", "topic", "share", "keys", "held")]
            for i in range(batch.num_rows):
                row = tuple(column[i].as_py() for column in columns)
                if rows and rows[-1][1:3] != row[1:3]:
                    yield from answer(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from answer(rows)

    met = asks.repartitionById(1 << bits, F.col("share").cast("int")).sortWithinPartitions("share", "topic", "gid")
    with small_batches(asks.sparkSession):
        return stored(met.mapInArrow(work, "gid long, topic int, share long, answer binary"))


def gathered(answers: DataFrame, packs: DataFrame) -> DataFrame:
    """One row per pack: gid and what it was answered, dealt like the buckets of ``packs``, so that these do not move."""
    return answers.repartition(bucket_count(packs), "gid").groupBy("gid").agg(F.collect_list(F.struct("topic", "share", "answer")).alias("answers"))


def read_answers(answers, kind) -> dict[int, np.ndarray]:
    """Per topic the answers of one pack in the order of its keys; ``answers`` is its list of structs or null."""
    parts: dict[int, list] = {}
    for row in sorted(answers or [], key=lambda r: (r["topic"], r["share"])):
        parts.setdefault(row["topic"], []).append(expand(row["answer"], kind))
    return {topic: np.concatenate(p) for topic, p in parts.items()}
