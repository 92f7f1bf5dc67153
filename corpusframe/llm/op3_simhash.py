"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints within a few bits of each other agree in some choice of bit pieces, so every choice deals the distinct
fingerprints out into shards. A shard's BK-tree (children keyed by their distance to the parent) is searched along the
edges within the radius only, and hands on one link per fingerprint to its local group. A shard too large for one tree
is not cut short: its fingerprints meet through their one-bit neighbours, groups of which never exceed 65.
Trees are not sent to all tasks, as their number grows with the documents; a shard's tree and its questions meet by key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import bounded, settle

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of one BK-tree.
SHARD = 512
#: Expected fingerprints of a shard from which on more pieces are compared.
CROWDED = 64


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of one text, as a signed number."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    width = min(SHINGLE, len(words))
    first = starts[: len(words) - width + 1].tolist()
    last = (starts + sizes - 1)[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), 1 << 15):
        ends = last[at : at + (1 << 15)]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 15)], ends)), np.uint64, len(ends))
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first)).view(">i8")[0])


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all values at most ``radius`` bits away."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)
        return found

    def add(self, value: int) -> int:
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while node != place:
            distance = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(distance, place)
        return place


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, first value of its group) of one shard's signed distinct values, groups of one left out."""
    tree, group = BKTree(), []

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for value in values:
        near = tree.within(value & (1 << 64) - 1, radius)
        place = tree.add(value & (1 << 64) - 1)
        group.append(place)
        for other in near:
            a, b = top(place), top(other)
            group[max(a, b)] = min(a, b)
    return [(values[i], values[top(i)]) for i in range(len(values)) if top(i) != i]


def _masks(n: int, radius: int = RADIUS) -> list[int]:
    """Signed masks; fingerprints within the radius agree under one of them. More bits for more fingerprints."""
    for kept in (1, 2, 3):
        pieces = kept + radius
        cuts = [64 * i // pieces for i in range(pieces + 1)]
        if n >> (64 * kept // pieces) < CROWDED:
            break
    bits = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(pieces)]
    masks = [sum(bits[i] for i in choice) for choice in combinations(range(pieces), kept)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join exactly what lies within the radius, at most a few per fingerprint."""
    masks = _masks(prints.count())
    keyed = prints.withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    keyed = keyed.select("print", "mask", F.xxhash64("mask", F.col("print").bitwiseAND(F.col("mask"))).alias("shard"))
    # Joins here meet two settled tables, one of them with single keys, so a hot key is split at run time.
    counts = settle(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    keyed = settle(keyed.join(counts, "shard"))

    def trees(batches):
        held_shard, held, out = None, [], []
        for batch in batches:
            for shard, value in zip(batch.column("shard").to_pylist(), batch.column("print").to_pylist()):
                if shard != held_shard:
                    out += shard_links(held)
                    held_shard, held = shard, []
                held.append(value)
            if out:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})
                out = []
        out = shard_links(held)
        if out:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})

    small = keyed.where(F.col("n") <= SHARD).select("shard", "print").repartition("shard").sortWithinPartitions("shard")
    found = small.mapInArrow(trees, "a long, b long")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = keyed.where(F.col("n") > SHARD).select("print").distinct().select("print", F.explode(F.concat(F.array("print"), flips)).alias("beside"))
    # All that share a one-bit neighbour are within two bits, and all within two bits share one.
    meet = around.groupBy("beside").agg(F.min("print").alias("b"), F.collect_set("print").alias("all")).where(F.size("all") > 1)
    crowded = meet.select(F.explode("all").alias("a"), "b").where("a <> b")
    return found.union(crowded).distinct()


def _contracted(links: DataFrame) -> DataFrame:
    """(a, b): every linked value with the smallest of its component, by alternating large and small stars."""
    edges, before = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # Every smaller neighbour, and the node itself, goes to the smallest.
        smallest = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(smallest, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        edges = settle(small.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges
        before = tuple(now)


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and print (the fingerprint as a long) of every row, and what ``more`` makes of it (longs)."""

    def work(batches):
        for batch in bounded(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            prints = pa.array([fingerprint(t or b"") for t in texts], pa.int64())
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), prints], [*kept, "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return rows.mapInArrow(work, ", ".join(f"`{name}` long" for name in [*(c for c in rows.columns if c != "text"), "print"]))


def _joined(marked: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """(print, root) of every fingerprint and (root, least) of every component, ``least`` the smallest of its rows."""
    prints = settle(marked.groupBy("print").agg(F.min(least).alias("least")))
    roots = _contracted(_links(prints.select("print")))
    rooted = settle(prints.join(roots.toDF("print", "root"), "print", "left").withColumn("root", F.coalesce("root", "print")))
    return rooted.select("print", "root"), settle(rooted.groupBy("root").agg(F.min("least").alias("least")))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    Null texts and those without a word have fingerprint zero and are linked like any other; fewer than three words
    make one shingle. Repeated rows appear each. A null doc_id never names a component unless no other id is in it.
    Other columns are not looked at; an empty table gives an empty one.
    """
    marked = settle(fingerprints(docs))
    rooted, named = _joined(marked, F.col("doc_id"))
    by_print = settle(rooted.join(named, "root").select("print", F.col("least").alias("component_id")))
    return marked.join(by_print, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of every component: the one with the smallest doc_id, a null id after all others.

    Rows are told apart by themselves and not by their ids: of rows with one id the one with the smallest hash of the
    text stays, and of repeated rows one. An empty table gives an empty one.
    """
    number = "_row"
    while number in map(str.lower, docs.columns):
        number += "_"
    # The numbers are written down with the rows, so every later reading finds them at the same rows.
    rows = settle(docs.withColumn(number, F.monotonically_increasing_id()))
    marked = settle(fingerprints(rows, F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col(number).alias("row")))
    _, least = _joined(marked, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "row"))
    return rows.join(least.select(F.col("least.row").alias(number)), number, "left_semi").select(*docs.columns)
