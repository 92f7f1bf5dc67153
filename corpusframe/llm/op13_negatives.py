"""Hard negatives from Hilbert-ordered blocks that carry zone maps.

Vectors become integers and are laid along a Hilbert curve through the directions in which a sample spreads most.
Consecutive rows form blocks, stored as a Parquet table; each has a zone map: the least and largest value of every
dimension, and the labels in it. Interval arithmetic over a zone map bounds the scores that an anchor can meet in its
block, from above and below, so a block is read only by anchors that it can have something for:

1. an anchor reads the block nearest to it on the curve; its k-th best positive there is a limit,
2. the blocks that can reach the limit give the positives,
3. the positives open windows of scores, and the blocks that can fall into one of them give the negatives.

Anchors travel in packs, zone maps in groups, and both meet by number; a pair of a pack and a block is one unit of
work, of bounded bytes. Bounds and scores are exact, so pruning never changes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import stored
from corpusframe.operators.scale import top_k

K = 5
#: Negatives score at least LOW and at most HIGH hundredths of the positive.
LOW, HIGH = 80, 100
SCALE = 256
#: Rows of a block, and bytes of a block, of a pack of anchors and of a group of zone maps.
BLOCK_ROWS, BLOCK_BYTES, PACK_BYTES, ZONE_BYTES = 512, 1 << 18, 1 << 19, 1 << 20
#: Rows that the curve's directions and steps are fitted on (they decide on pruning only, never on rows).
SAMPLE = 1024
#: Dimensions the curve runs through, and all of its bits.
CURVE_DIMENSIONS, CURVE_BITS = 12, 60
#: Packs travel to all tasks up to this size; beyond it they are shuffled.
BROADCAST_BYTES = 8 << 20
#: Scores are exact in doubles below this; others are added up as whole numbers.
EXACT = 2.0**53 / 128
LONG = 2**63 - 1

BLOCK = "width int, kind string, ids binary, labels binary, data binary"


def usable(table: DataFrame, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", swapped: int = 7) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that take part; every ``swapped``-th id gets the next of ten labels."""
    v, i, label = F.col(vector_column).cast("array<double>"), F.col(id_column).cast("long"), F.col(label_column).cast("int")
    rows = table.select(i.alias("vec_id"), F.when(i % swapped == 0, (label + 1) % 10).otherwise(label).alias("label"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x), still as doubles, which hold it exactly."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(vectors * SCALE, -np.finfo(float).max, np.finfo(float).max))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points given by their cell in every dimension (Skilling's transform)."""
    x = cells.astype(np.int64).copy()
    n, top = x.shape[1], 1 << (bits - 1)
    step = top
    while step > 1:
        low = step - 1
        for d in range(n):
            turned = (x[:, d] & step) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            # In the first dimension a swap is with itself.
            if d:
                x[:, d] ^= swap
        step >>= 1
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    flips = np.zeros(len(x), np.int64)
    step = top
    while step > 1:
        flips ^= np.where(x[:, n - 1] & step, step - 1, 0)
        step >>= 1
    x ^= flips[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            place = (place << 1) | ((x[:, d] >> bit) & 1)
    return place


def fit_curve(rows: DataFrame) -> dict:
    """By width: a centre, directions and the steps along them, from the SAMPLE rows with the least hash."""
    sample = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE).select("vector").toArrow().column(0)
    by_width: dict[int, list] = {}
    for vector in sample.to_pylist():
        by_width.setdefault(len(vector), []).append(vector)
    curve = {}
    for width, vectors in by_width.items():
        if not width:
            continue
        points = np.array(vectors)
        size = np.abs(points).max() or 1.0
        points = points / size
        centre = points.mean(0)
        n = min(CURVE_DIMENSIONS, width)
        axes = np.linalg.svd(points - centre, full_matrices=True)[2][:n].T
        bits = min(CURVE_BITS // n, 5)
        steps = np.quantile((points - centre) @ axes, np.arange(1, 1 << bits) / (1 << bits), axis=0)
        curve[width] = (size, centre, axes, steps, bits)
    return curve


def places(vectors: np.ndarray, curve: dict) -> np.ndarray:
    """Places on the curve of rows of one width; a width without a sample has one place."""
    if vectors.shape[1] not in curve:
        return np.zeros(len(vectors), np.int64)
    size, centre, axes, steps, bits = curve[vectors.shape[1]]
    along = (vectors / size - centre) @ axes
    return hilbert(np.stack([np.searchsorted(steps[:, d], along[:, d], "right") for d in range(axes.shape[1])], 1), bits)


def _by_width(batch: pa.RecordBatch, column: str):
    """(rows, matrix) for every width in a batch."""
    lists = batch.column(column)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    widths = np.diff(ends)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, flat[ends[rows][:, None] + np.arange(width)[None, :]].reshape(len(rows), width)


def with_place(rows: DataFrame, curve: dict) -> DataFrame:
    """vec_id, label, place, width and the whole numbers of every row."""

    def work(batches):
        for batch in batches:
            for at, vectors in _by_width(batch, "vector"):
                took = batch.take(pa.array(at))
                numbers = whole(vectors)
                yield pa.RecordBatch.from_arrays(
                    [took.column("vec_id"), took.column("label"), pa.array(places(vectors, curve)),
                     pa.array(np.full(len(at), vectors.shape[1], np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * vectors.shape[1], pa.int32()), pa.array(numbers.ravel()))],
                    ["vec_id", "label", "place", "width", "numbers"])

    return rows.mapInArrow(work, "vec_id long, label int, place long, width int, numbers array<double>")


def _packed(ids: list, labels: list, numbers: list) -> dict:
    """Columns BLOCK of rows of one width, in the smallest type that holds the numbers."""
    data = np.stack(numbers)
    most = np.abs(data).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return {
        "width": data.shape[1], "kind": kind, "ids": np.array(ids, np.int64).tobytes(),
        "labels": np.array(labels, np.int32).tobytes(), "data": data.astype(kind).tobytes()}


def _opened(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row[prefix + "ids"], np.int64), np.frombuffer(row[prefix + "labels"], np.int32)
    return ids, labels, np.frombuffer(row[prefix + "data"], row[prefix + "kind"]).astype(np.float64).reshape(len(ids), row["width"])


def cut_blocks(placed: DataFrame) -> DataFrame:
    """The stored table of blocks: BLOCK, block, the ends of its stretch of the curve, least and largest numbers, labels."""

    def work(batches):
        task, held, recent = TaskContext.get().partitionId() << 32, {}, {}

        def row(width):
            nonlocal task
            own = held.pop(width)
            columns = _packed(own["ids"], own["labels"], own["numbers"])
            data = np.stack(own["numbers"])
            task += 1
            return pa.RecordBatch.from_pylist([columns | {
                "block": task - 1, "first": own["places"][0], "last": own["places"][-1],
                "least": data.min(0, initial=np.inf).tobytes(), "most": data.max(0, initial=-np.inf).tobytes(),
                "own_labels": np.unique(np.array(own["labels"], np.int32)).tobytes()}], schema)

        for batch in batches:
            widths, spots = batch.column("width").to_numpy(), batch.column("place").to_numpy()
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            matrix = {int(i): m for at, ms in _by_width(batch, "numbers") for i, m in zip(at, ms)}
            for i in range(len(ids)):
                # Equal rows stand together; each counts once.
                same = (int(spots[i]), int(ids[i]))
                if recent.get("key") != same:
                    recent = {"key": same, "seen": set()}
                mark = (int(labels[i]), matrix[i].tobytes())
                if mark in recent["seen"]:
                    continue
                recent["seen"].add(mark)
                width = int(widths[i])
                own = held.setdefault(width, {"ids": [], "labels": [], "numbers": [], "places": []})
                own["ids"].append(int(ids[i]))
                own["labels"].append(int(labels[i]))
                own["numbers"].append(matrix[i].copy())
                own["places"].append(int(spots[i]))
                if len(own["ids"]) >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(width, 1)))):
                    yield row(width)
        for width in list(held):
            yield row(width)

    schema = pa.schema([
        ("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("data", pa.binary()),
        ("block", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("least", pa.binary()), ("most", pa.binary()), ("own_labels", pa.binary())])
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["place", "vec_id", "label"]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ranged.mapInArrow(work, BLOCK + ", block long, first long, last long, least binary, most binary, own_labels binary"))


def pack_anchors(placed: DataFrame) -> DataFrame:
    """The stored table of packs of distinct anchors: BLOCK, pack and the anchors' places on the curve."""
    anchors = stored(placed.distinct())
    size = anchors.agg(F.sum(F.col("width").cast("long") * 8 + 32).alias("bytes")).first().bytes or 0

    def work(batches):
        pack, held = TaskContext.get().partitionId() << 32, {}

        def row(width):
            nonlocal pack
            own = held.pop(width)
            pack += 1
            return pa.RecordBatch.from_pylist([_packed(*own[:3]) | {"pack": pack - 1, "spots": np.array(own[3], np.int64).tobytes()}], schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("vec_id", "label", "place")]
            for at, matrix in _by_width(batch, "numbers"):
                for i, numbers in zip(at, matrix):
                    own = held.setdefault(len(numbers), ([], [], [], []))
                    for part, value in zip(own, (columns[0][i], columns[1][i], numbers, columns[2][i])):
                        part.append(value)
                    if len(own[0]) * 8 * max(len(numbers), 1) >= PACK_BYTES:
                        yield row(len(numbers))
        for width in list(held):
            yield row(width)

    schema = pa.schema([
        ("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("data", pa.binary()),
        ("pack", pa.int64()), ("spots", pa.binary())])
    return stored(anchors.repartition(max(1, -(-size // PACK_BYTES))).mapInArrow(work, BLOCK + ", pack long, spots binary"))


def group_zones(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Zone maps in groups (one row each, numbered from 0), read without the blocks' rows; and the number of groups."""
    zones = blocks.select("block", "width", "first", "last", "least", "most", "own_labels")
    size = zones.agg(F.sum(F.col("width").cast("long") * 16 + 64).alias("bytes")).first().bytes or 0
    groups = max(1, -(-size // ZONE_BYTES))

    def work(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.concat_tables(tables)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        yield pa.RecordBatch.from_pydict({"zone_group": pa.array([TaskContext.get().partitionId()], pa.int32()), "zones": [sink.getvalue().to_pybytes()]})

    return stored(zones.repartition(groups).mapInArrow(work, "zone_group int, zones binary")), groups


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors x blocks) the lowest and the highest score that a row between ``least`` and ``most`` can have."""
    positive, negative = np.maximum(anchors, 0), np.minimum(anchors, 0)
    if not _exact(anchors, np.concatenate([least, most])):
        return np.full((len(anchors), len(least)), -np.inf), np.full((len(anchors), len(least)), np.inf)
    return positive @ least.T + negative @ most.T, positive @ most.T + negative @ least.T


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    with np.errstate(over="ignore"):
        return bool(np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; beyond the range of a long its end."""
    if _exact(anchors, rows):
        return anchors @ rows.T
    to_ints = np.frompyfunc(int, 1, 1)
    return np.clip(np.dot(to_ints(anchors), to_ints(rows).T), -LONG, LONG)


def best(found: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of every row, equal ones by the smaller id."""
    rows, columns = np.nonzero(allowed)
    if found.dtype != object and allowed.shape[1] > k:
        masked = np.where(allowed, found, -np.inf)
        least = np.partition(masked, -k, axis=1)[:, -k]
        keep = masked[rows, columns] >= least[rows]
        rows, columns = rows[keep], columns[keep]
    values = found[rows, columns]
    if found.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -values[i], ids[columns[i]])), np.int64)
    else:
        order = np.lexsort((ids[columns], -values, rows))
    rows, columns = rows[order], columns[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[keep], columns[keep]


def _meet(packs: DataFrame, zones: DataFrame, groups: int, choose, schema: pa.Schema, ddl: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``choose`` over every pack and group of zone maps of its width. It is given the pack's row and the zones' columns."""
    every = packs.withColumn("zone_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def work(table):
        out = []
        for row in table.to_pylist():
            zone = pa.ipc.open_stream(row["zones"]).read_all()
            zone = zone.filter(pa.compute.equal(zone.column("width"), row["width"]))
            if zone.num_rows:
                out.append(choose(row, zone))
        return pa.concat_tables(out) if out else schema.empty_table()

    return every.join(zones, "zone_group").groupBy("pack", "zone_group").applyInArrow(work, ddl)


def _read(requests: DataFrame, packs: DataFrame, blocks: DataFrame, look, schema: pa.Schema, ddl: str) -> DataFrame:
    """``look`` at every pack's chosen anchors (``rows``) in a block; one pair is held at a time."""
    theirs = packs.withColumnsRenamed({c: f"anchor_{c}" for c in ("kind", "ids", "labels", "data")}).drop("width", "spots")
    # One row per pack and block first, so that blocks are moved once and packs where they are small are not.
    pairs = blocks.select("block", "width", "kind", "ids", "labels", "data").join(requests, "block").join(theirs, "pack")

    def work(table):
        out = [look(row) for row in table.to_pylist()]
        return pa.concat_tables(out) if out else schema.empty_table()

    return pairs.groupBy("block", "pack").applyInArrow(work, ddl)


_REQUEST = pa.schema([("pack", pa.int64()), ("block", pa.int64()), ("rows", pa.binary())])
_REQUEST_DDL = "pack long, block long, rows binary"


def _requests(row: dict, zone: pa.Table, wanted: np.ndarray) -> pa.Table:
    """One row per block that any anchor of the pack must read, with those anchors."""
    blocks, hit = zone.column("block").to_pylist(), np.flatnonzero(wanted.any(0))
    return pa.table({
        "pack": pa.array([row["pack"]] * len(hit), pa.int64()), "block": pa.array([blocks[z] for z in hit], pa.int64()),
        "rows": pa.array([np.flatnonzero(wanted[:, z]).astype(np.int32).tobytes() for z in hit], pa.binary())}, _REQUEST)


def _zone_arrays(zone: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    stack = lambda c: np.stack([np.frombuffer(x).reshape(width) for x in zone.column(c).to_pylist()])
    return stack("least"), stack("most"), [np.frombuffer(x, np.int32) for x in zone.column("own_labels").to_pylist()]


def _near(packs: DataFrame) -> DataFrame:
    """Packs that travel to all tasks while they are small, checked; else packs that are shuffled."""
    size = packs.agg(F.sum(F.octet_length("data") + F.octet_length("ids") * 3).alias("bytes")).first().bytes or 0
    return F.broadcast(packs) if size <= BROADCAST_BYTES else packs


def nearest_blocks(packs: DataFrame, zones: DataFrame, groups: int) -> DataFrame:
    """Requests of every anchor for the block nearest to it on the curve."""
    schema = pa.schema([("pack", pa.int64()), ("row", pa.int32()), ("block", pa.int64()), ("away", pa.int64())])

    def choose(row, zone):
        spots = np.frombuffer(row["spots"], np.int64)[:, None]
        first, last = (zone.column(c).to_numpy()[None, :] for c in ("first", "last"))
        away = np.maximum(np.maximum(first - spots, spots - last), 0)
        to = away.argmin(1)
        rows = np.arange(len(spots))
        return pa.table([np.full(len(spots), row["pack"]), rows.astype(np.int32), zone.column("block").to_numpy()[to], away[rows, to]], schema=schema)

    per = _meet(packs, zones, groups, choose, schema, "pack long, row int, block long, away long")
    one = per.groupBy("pack", "row").agg(F.min_by("block", F.struct("away", "block")).alias("block"))
    # An anchor's number in its pack, as the four bytes a request holds.
    return one.groupBy("pack", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def positives(packs: DataFrame, blocks: DataFrame, zones: DataFrame, groups: int, k: int = K) -> DataFrame:
    """pack, row, place (from 1), positive_id, positive_score: the k best other rows of an anchor's label."""
    schema = pa.schema([("pack", pa.int64()), ("row", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    ddl = "pack long, row int, positive_id long, positive_score long"

    def look(row):
        ids, labels, data = _opened(row)
        own, own_labels, numbers = _opened(row, "anchor_")
        rows = np.asarray(row["rows"], np.int32) if isinstance(row["rows"], list) else np.frombuffer(row["rows"], np.int32)
        found = scores(numbers[rows], data)
        allowed = (own_labels[rows][:, None] == labels[None, :]) & (own[rows][:, None] != ids[None, :])
        at, to = best(found, allowed, ids, k)
        return pa.table([np.full(len(at), row["pack"]), rows[at], ids[to], found[at, to].astype(np.int64)], schema=schema)

    near = _near(packs)
    order = [F.col("positive_score").desc(), F.col("positive_id").asc()]
    first = _read(nearest_blocks(near, zones, groups), near, blocks, look, schema, ddl)
    limits = first.groupBy("pack", "row").agg(F.sort_array(F.collect_list("positive_score")).alias("found"))
    limits = limits.where(F.size("found") >= k).groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("row", F.col("found")[0]))).alias("limits"))
    limited = stored(packs.join(limits, "pack", "left"))

    def choose(row, zone):
        _, labels, numbers = _opened(row)
        limit = np.full(len(labels), -np.inf)
        for at, value in row["limits"] or []:
            limit[at] = value
        least, most, kinds = _zone_arrays(zone, row["width"])
        high = bounds(numbers, least, most)[1]
        has = np.stack([np.isin(labels, kind) for kind in kinds], 1)
        return _requests(row, zone, has & (high >= limit[:, None]))

    chosen = _meet(_near(limited), zones, groups, choose, _REQUEST, _REQUEST_DDL)
    found = _read(chosen, near, blocks, look, schema, ddl)
    return top_k(found, ["pack", "row"], order, k, "place")


def negatives(packs: DataFrame, blocks: DataFrame, zones: DataFrame, groups: int, found: DataFrame, k: int = K, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    windows = found.groupBy("pack").agg(F.collect_list(F.struct("row", "place", "positive_id", "positive_score")).alias("windows"))
    opened = stored(packs.join(windows, "pack"))
    schema = pa.schema([
        ("pack", pa.int64()), ("row", pa.int32()), ("place", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()),
        ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])
    ddl = "pack long, row int, place int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"

    def choose(row, zone):
        _, labels, numbers = _opened(row)
        least, most, kinds = _zone_arrays(zone, row["width"])
        below, above = bounds(numbers, least, most)
        other = np.stack([np.any(labels[:, None] != kind[None, :], 1) for kind in kinds], 1)
        wanted = np.zeros(other.shape, bool)
        for w in row["windows"]:
            score = float(w["positive_score"])
            wanted[w["row"]] |= (100 * above[w["row"]] >= low * score) & (100 * below[w["row"]] <= high * score)
        return _requests(row, zone, wanted & other)

    def look(row):
        ids, labels, data = _opened(row)
        own, own_labels, numbers = _opened(row, "anchor_")
        rows = np.frombuffer(row["rows"], np.int32)
        score = scores(numbers[rows], data)
        other = own_labels[rows][:, None] != labels[None, :]
        at = np.full(len(own), -1)
        at[rows] = np.arange(len(rows))
        asked = [w for w in row["windows"] if at[w["row"]] >= 0]
        line = at[[w["row"] for w in asked]]
        # Whole numbers, not doubles, where products beyond doubles are compared.
        to = np.array([w["positive_score"] for w in asked], object if score.dtype == object else np.float64)[:, None]
        out = []
        for start in range(0, len(asked), 512):
            part = slice(start, start + 512)
            mine, top = score[line[part]], to[part]
            allowed = other[line[part]] & (100 * mine >= low * top).astype(bool) & (100 * mine <= high * top).astype(bool)
            a, b = best(mine, allowed, ids, k)
            w = [asked[start + i] for i in a]
            out.append(pa.table([
                np.full(len(a), row["pack"]), pa.array([x["row"] for x in w], pa.int32()), pa.array([x["place"] for x in w], pa.int32()),
                own[[x["row"] for x in w]] if w else np.zeros(0, np.int64), pa.array([x["positive_id"] for x in w], pa.int64()), ids[b],
                pa.array([x["positive_score"] for x in w], pa.int64()), mine[a, b].astype(np.int64)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    near = _near(opened)
    chosen = _meet(near, zones, groups, choose, _REQUEST, _REQUEST_DDL)
    rows = _read(chosen, near, blocks, look, schema, ddl)
    ranked = top_k(rows, ["pack", "row", "place"], [F.col("negative_score").desc(), F.col("negative_id").asc()], k)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine(
    table: DataFrame, every: int = 100, k: int = K, low: int = LOW, high: int = HIGH,
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """The first ``k`` negatives of each anchor (ids divisible by ``every``) and each of its first ``k`` positives.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Rows meet rows of their own
    width; empty vectors are a width. Rows that agree in id, label and whole numbers are one row; an id with other
    numbers is another row, but never a partner of its own id's positives. Equal scores go by the smaller id. A score
    beyond the range of a long counts as its end. Other columns are not read; an empty table has no rows.
    """
    rows = usable(table, id_column, label_column, vector_column)
    placed = with_place(rows, fit_curve(rows))
    blocks = cut_blocks(placed)
    packs = pack_anchors(placed.where(F.col("vec_id") % every == 0))
    zones, groups = group_zones(blocks)
    found = stored(positives(packs, blocks, zones, groups, k))
    return negatives(packs, blocks, zones, groups, found, k, low, high)


SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT a.vec_id AS anchor_id, a.q AS anchor, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint AS score
  FROM whole a JOIN whole b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, anchor ORDER BY score DESC, vec_id) AS place FROM pair WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.anchor, p.place ORDER BY n.score DESC, n.vec_id)::int AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND n.anchor = p.anchor AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
