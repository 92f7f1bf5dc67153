"""An inverted file over chunk vectors: lists of rows around centroids, so that a question reads few of them.

Centroids are fitted on a bounded sample; every row is then stored under its nearest centroid, one folder per list. A
question reads the lists whose centroids are nearest to it and compares exactly inside them. How many lists that takes
is measured when the index is written: sampled rows are searched exactly, and the number of lists is the one that holds
the wanted share of what they found. ``certified`` search goes on with every list that the triangle inequality cannot
rule out, so its answer is that of the full scan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.config import DEFAULT, Config
from corpusframe.operators import vector
from corpusframe.operators.scale import top_k
from corpusframe.session import settle, ship

_ROWS = "list int, away double, chunk_id string, document_id string, section_id string, embedding array<double>"
_STORED = "share int, chunk_id string, document_id string, section_id string, embedding array<double>, list int"
#: Rounds of refinement of the centroids over the sample.
ROUNDS = 12
#: Questions whose distances to all centroids are worked out at once.
_STEP = 256


@dataclass(frozen=True)
class VectorLists:
    centroids: DataFrame  # list, width, centre, radius, rows, shares
    rows: DataFrame       # list (a folder each), share, chunk_id, document_id, section_id, embedding
    probes: int           # lists a question reads

    @staticmethod
    def read(spark: SparkSession, path: str) -> "VectorLists":
        return VectorLists(
            spark.read.parquet(f"{path}/centroids"), spark.read.schema(_STORED).parquet(f"{path}/rows"),
            spark.read.parquet(f"{path}/probes").first()["probes"])


class _Centroids:
    """All centroids, at most config.max_lists; they travel to every task."""

    def __init__(self, rows: list[tuple[int, list[float]]]) -> None:
        by_width: dict[int, list[tuple[int, list[float]]]] = {}
        for number, centre in rows:
            by_width.setdefault(len(centre), []).append((number, centre))
        self.by_width = {
            width: (np.array([n for n, _ in some]), np.array([c for _, c in some], dtype=np.float64))
            for width, some in by_width.items()}

    def distances(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list numbers, Euclidean distances of every row to each of them) among lists of the rows' width."""
        numbers, centres = self.by_width.get(matrix.shape[1], (np.zeros(0, np.int64), np.zeros((0, matrix.shape[1]))))
        square = (matrix * matrix).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * matrix @ centres.T
        return numbers, np.sqrt(np.maximum(square, 0.0))


def _clusters(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of k groups by Lloyd's rounds; a group that empties starts again at the farthest point."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), size=min(k, len(points)), replace=False)]
    for _ in range(ROUNDS):
        square = (points * points).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * points @ centres.T
        nearest = square.argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled][:, None]
        far = np.argsort(-square[np.arange(len(points)), nearest], kind="stable")[: (~filled).sum()]
        centres[~filled] = points[far]
    return np.unique(centres, axis=0)


def _candidates(chunks: DataFrame) -> DataFrame:
    section = F.col("section_id") if "section_id" in chunks.columns else F.lit(None)
    return chunks.where(F.size("embedding") > 0).select(
        F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"),
        section.cast("string").alias("section_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _sample(rows: DataFrame, salt: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the least hash: the same ones in every run."""
    return rows.orderBy(F.xxhash64(F.lit(salt), "chunk_id"), "chunk_id").limit(limit)


def _fit(rows: DataFrame, total: int, config: Config) -> list[tuple[int, list[float]]]:
    width = max(rows.agg(F.max(F.size("embedding")).alias("w")).first()["w"] or 1, 1)
    sample = _sample(rows, "centroids", max(1, min(config.list_sample, config.resident_values // width)))
    by_width: dict[int, list] = {}
    for (vector_,) in sample.select("embedding").collect():
        by_width.setdefault(len(vector_), []).append(vector_)
    size = sum(map(len, by_width.values()))
    lists = min(config.max_lists, max(1, round(total**0.5)))
    found: list[tuple[int, list[float]]] = []
    for width, some in sorted(by_width.items()):
        share = max(1, round(lists * len(some) / size))
        for centre in _clusters(np.array(some, dtype=np.float64), share, width):
            found.append((len(found), centre.tolist()))
    return found


def _assigned(rows: DataFrame, centroids) -> DataFrame:
    """Every row under its nearest centroid. A width that the sample lacks has list -1 - width, read by all its questions."""

    def assign(batches):
        for batch in batches:
            for at, matrix in vector._vectors(batch.column(3)):
                numbers, away = centroids.value.distances(matrix)
                took = batch.take(pa.array(at))
                if len(numbers):
                    nearest = away.argmin(1)
                    where, far = numbers[nearest], away[np.arange(len(at)), nearest]
                else:
                    where, far = np.full(len(at), -1 - matrix.shape[1]), np.linalg.norm(matrix, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), pa.array(far, pa.float64()), *[took.column(i) for i in range(3)],
                     took.column(3)], names=[f.split()[0] for f in _ROWS.split(", ")])

    return rows.mapInArrow(assign, _ROWS)


def write_lists(chunks: DataFrame, path: str, config: Config = DEFAULT) -> VectorLists:
    """Fit, assign and store the lists of all chunk vectors, and measure how many a question must read.

    chunks(chunk_id, document_id[, section_id], embedding). A list above config.block_vectors rows is split into
    shares, so no list is too large for one task, however many copies of one vector there are.
    """
    spark = chunks.sparkSession
    ship(spark)
    rows = _candidates(chunks)
    total = rows.count()
    fitted = _fit(rows, total, config)
    shared = spark.sparkContext.broadcast(_Centroids(fitted))
    placed = settle(_assigned(rows, shared))
    sizes = placed.groupBy("list").agg(
        F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"), F.max(F.size("embedding")).alias("width"))
    shares = F.ceil(F.greatest(F.col("rows") / config.block_vectors, F.col("rows") * F.col("width") / config.block_values))
    centres = spark.createDataFrame(fitted, "list int, centre array<double>")
    sizes = sizes.join(F.broadcast(centres), "list", "left").select(
        "list", "width", F.coalesce("centre", F.array_repeat(F.lit(0.0), F.col("width"))).alias("centre"), "radius",
        "rows", F.greatest(shares, F.lit(1)).cast("int").alias("shares"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    stored = spark.read.parquet(f"{path}/centroids")
    split = placed.join(F.broadcast(stored.select("list", "shares")), "list").withColumn(
        "share", F.pmod(F.xxhash64("chunk_id"), F.col("shares")).cast("int"))
    split.select("list", "share", "chunk_id", "document_id", "section_id", "embedding").repartition("list", "share").write.mode(
        "overwrite").partitionBy("list").parquet(f"{path}/rows")
    probes = _calibrated(rows, placed, shared, max(len(fitted), 1), config)
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return VectorLists.read(spark, path)


def _calibrated(rows: DataFrame, placed: DataFrame, shared, lists: int, config: Config) -> int:
    """Lists to read so that they hold config.list_recall of the neighbours of sampled rows, found by the full scan."""
    asked = settle(_sample(rows, "probes", config.list_questions).select(F.col("chunk_id").alias("question_id"), "embedding"))
    hits = vector.nearest(asked, rows, config.top_k + 1, config=config).where("chunk_id <> question_id")
    home = placed.select("chunk_id", "list").distinct()
    ranked = _probed(asked, shared, None).select("question_id", "list", "place")
    places = hits.select("question_id", "chunk_id").join(home, "chunk_id").join(ranked, ["question_id", "list"])
    found = places.agg(F.percentile("place", config.list_recall).alias("p")).first()["p"]
    return min(lists, int(np.ceil(found)) if found is not None else 1)


_PROBED = "question_id {}, embedding array<double>, list int, place int, gap double"


def _probed(asked: DataFrame, shared, probes: int | None) -> DataFrame:
    """A row per question and list, nearest lists first; the first ``probes`` of them."""
    schema = _PROBED.format(asked.schema["question_id"].dataType.simpleString())
    names = T.StructType.fromDDL(schema).names

    def probe(batches):
        for batch in batches:
            for at, matrix in vector._vectors(batch.column(1)):
                took = batch.take(pa.array(at))
                for start in range(0, len(at), 64):
                    part = matrix[start:start + 64]
                    numbers, away = shared.value.distances(part)
                    if not len(numbers):
                        numbers, away = np.array([-1 - part.shape[1]]), np.zeros((len(part), 1))
                    order = np.argsort(away, axis=1, kind="stable")[:, :probes]
                    n = order.shape[1]
                    again = took.slice(start, len(part)).take(pa.array(np.repeat(np.arange(len(part)), n)))
                    yield pa.RecordBatch.from_arrays([
                        again.column(0), again.column(1), pa.array(numbers[order].ravel(), pa.int32()),
                        pa.array(np.tile(np.arange(1, n + 1), len(part)), pa.int32()),
                        pa.array(np.take_along_axis(away, order, 1).ravel())], names=names)

    return asked.select("question_id", "embedding").mapInArrow(probe, schema)


def search(
    questions: DataFrame, index: VectorLists, top: int | None = None, probes: int | None = None,
    certified: bool = False, config: Config = DEFAULT,
) -> DataFrame:
    """k nearest chunks per question as ``vector.nearest`` gives them, from the lists that each question reads.

    questions(question_id, embedding). ``probes`` overrides the measured number of lists. With ``certified`` a second
    pass reads every further list that may hold a nearer row than the k-th found, so all answers are exact.
    Questions with scopes belong to ``vector.nearest``, which reads the vectors of their documents only.
    """
    spark, limit = questions.sparkSession, top or config.top_k
    ship(spark)
    asked = questions.where(F.size("embedding") > 0).select("question_id", F.col("embedding").cast("array<double>").alias("embedding"))
    known, first = index.centroids.collect(), probes or index.probes
    order = [F.asc("score"), F.asc("chunk_id")]
    found = _inside(asked.withColumn("worst", F.lit(None).cast("double")), index, known, (0, first), limit, config)
    if not certified:
        return top_k(found, ["question_id"], order, limit)
    found = settle(found)
    reached = top_k(found, ["question_id"], order, limit).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("score").alias("worst"))
    limits = reached.where(F.col("_n") == limit).select("question_id", "worst")
    again = settle(asked.join(limits, "question_id", "left"))
    # With a distance to beat few rows are kept, so more questions fit into a block and the lists' rows move less often.
    more = _inside(again, index, known, (first, len(known)), limit, replace(config, block_questions=4 * config.block_questions))
    return top_k(found.unionByName(more), ["question_id"], order, limit)


def _reads(centroids: _Centroids, radii: dict[int, float], matrix: np.ndarray, worst: np.ndarray, places: tuple[int, int]):
    """(list numbers, which of them every row reads): the nearest ones from one place to another, without those that hold
    nothing as near as the row's ``worst`` (squared; NaN where none is known)."""
    numbers, away = centroids.distances(matrix)
    if not len(numbers):
        numbers, away = np.array([-1 - matrix.shape[1]]), np.zeros((len(matrix), 1))
    place = np.empty(away.shape, dtype=np.int64)
    np.put_along_axis(place, np.argsort(away, axis=1, kind="stable"), np.arange(len(numbers))[None, :], 1)
    # The margin covers the rounding of distances; a list too many costs time only.
    radius = np.array([radii.get(int(n), 0.0) for n in numbers])
    far = away - radius > np.sqrt(worst)[:, None] + 1e-4 * (1 + away)
    return numbers, (place >= places[0]) & (place < places[1]) & ~far


def _reading(batches, shared, radii: dict[int, float], places: tuple[int, int]):
    """(row numbers, list numbers, which lists each of them reads) of bounded parts of batches of embedding and worst."""
    for batch in batches:
        worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(np.float64)
        for at, matrix in vector._vectors(batch.column("embedding")):
            for low in range(0, len(at), _STEP):
                some = at[low:low + _STEP]
                yield batch, some, *_reads(shared.value, radii, matrix[low:low + _STEP], worst[some], places)


def _bundles(known: list, counts: dict[int, int], asked: int, cores: int, config: Config) -> list[tuple[int, int, int, int]]:
    """(list, bundle, shares, blocks of questions) of the lists read: lists beside each other make one bundle.

    A question then moves once per bundle and keeps k rows there, however many lists it reads. A bundle holds no more rows
    than a share of a list may; a list of several shares is a bundle of its own.
    """
    reading = {r["list"]: r for r in known if r["list"] in counts}
    blocks = -(-asked // config.block_questions)
    # Few rows make bundles enough for all cores, many are bounded by what a task may hold.
    fair = -(-sum(r["rows"] for r in reading.values()) * max(blocks, 1) // (2 * cores))
    plan, bundle = [], -1
    for width in sorted({r["width"] for r in reading.values()}):
        values = max(1, config.block_values // width)
        most, block = max(1, min(config.block_vectors, values, fair)), min(config.block_questions, values)
        left = {n: np.array(r["centre"]) for n, r in sorted(reading.items()) if r["width"] == width}
        members: list[list[int]] = []
        held, here = 0, next(iter(left.values()))
        while left:
            numbers = list(left)
            number = numbers[int(((np.array(list(left.values())) - here) ** 2).sum(1).argmin())]
            here, row = left.pop(number), reading[number]
            alone = row["shares"] > 1
            if not members or alone or held + row["rows"] > most:
                members.append([])
                held = 0
            members[-1].append(number)
            held = most if alone else held + row["rows"]
        for some in members:
            bundle += 1
            asking = min(asked, sum(counts[n] for n in some))
            plan += [(n, bundle, reading[n]["shares"], -(-asking // block)) for n in some]
    return plan


def _inside(asked: DataFrame, index: VectorLists, known: list, places: tuple[int, int], limit: int, config: Config) -> DataFrame:
    """The best rows of every question in the lists it reads; a bundle of lists meets a bounded block of questions.

    asked(question_id, embedding, worst): rows farther than ``worst`` may be left out. ``places``: see ``_reads``.
    """
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast(_Centroids([(r["list"], r["centre"]) for r in known if r["list"] >= 0]))
    radii = {r["list"]: r["radius"] for r in known}

    def count(batches):
        for batch, some, numbers, reads in _reading(batches, shared, radii, places):
            # The questions themselves count under no list.
            yield pa.RecordBatch.from_arrays([
                pa.array([*numbers.tolist(), None], pa.int32()), pa.array([*reads.sum(0).tolist(), len(some)], pa.int64())], names=["list", "n"])

    # At most max_lists numbers: the folders to read, and how many questions read each.
    rows = asked.select("embedding", "worst").mapInArrow(count, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()
    counts = {r["list"]: r["n"] for r in rows if r["list"] in radii and r["n"]}
    total = sum(r["n"] for r in rows if r["list"] is None)
    plan = _bundles(known, counts, total, spark.sparkContext.defaultParallelism, config)
    members: dict[int, list[int]] = {}
    for number, bundle, *_ in plan:
        members.setdefault(bundle, []).append(number)
    home = {number: bundle for number, bundle, *_ in plan}
    schema_in = T.StructType([
        asked.schema["question_id"], asked.schema["embedding"], asked.schema["worst"],
        T.StructField("bundle", T.IntegerType()), T.StructField("reads", T.BinaryType())])

    def place(batches):
        for batch, some, numbers, reads in _reading(batches, shared, radii, places):
            column = {int(n): i for i, n in enumerate(numbers)}
            for bundle in sorted({home[n] for n in column if n in home}):
                bits = reads[:, [column[n] for n in members[bundle]]]
                who = np.flatnonzero(bits.any(1))
                if not len(who):
                    continue
                packed = [row.tobytes() for row in np.packbits(bits[who], axis=1)]
                took = batch.take(pa.array(some[who]))
                yield pa.RecordBatch.from_arrays([
                    *[took.column(i) for i in range(3)], pa.array(np.full(len(who), bundle), pa.int32()), pa.array(packed, pa.binary())],
                    names=schema_in.names)

    of_list = F.broadcast(spark.createDataFrame([(n, b, k) for n, b, _, k in plan], "list int, bundle int, blocks int"))
    of_bundle = F.broadcast(spark.createDataFrame(list(dict.fromkeys(p[1:] for p in plan)), "bundle int, shares int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.select("question_id", "embedding", "worst").mapInArrow(place, schema_in).join(of_bundle, "bundle").withColumn(
        "share", every("shares")).withColumn("block", F.pmod(F.xxhash64("question_id"), F.col("blocks")).cast("int"))
    right = index.rows.where(F.col("list").isin(list(home))).join(of_list, "list").withColumn("block", every("blocks"))
    out = T.StructType([
        asked.schema["question_id"], T.StructField("chunk_id", T.StringType()), T.StructField("document_id", T.StringType()),
        T.StructField("section_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("k", T.LongType())])
    schema = vector._arrow_schema(out)

    def meet(asking: pa.Table, rows: pa.Table) -> pa.Table:
        ids, vectors = asking.column("question_id").to_pylist(), [None] * asking.num_rows
        for at, matrix in vector._vectors(asking.column("embedding")):
            for i, value in zip(at, matrix):
                vectors[i] = value
        worst = asking.column("worst").to_numpy().astype(np.float64)
        state = vector._Questions([(i, v, None, None, limit) for i, v in zip(ids, vectors)], "l2")
        best = vector._Best(state, np.where(np.isnan(worst), np.inf, worst))
        if ids and rows.num_rows:
            some = members[asking.column("bundle")[0].as_py()]
            bits = np.unpackbits(np.frombuffer(b"".join(asking.column("reads").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1)
            of = rows.column("list").to_numpy()
            for column, number in enumerate(some):
                here = rows.select(["chunk_id", "document_id", "section_id", "embedding"]).take(pa.array(np.flatnonzero(of == number)))
                vector._scan(state, here, best, bits[:, column] == 1)
        return pa.Table.from_batches([vector._emit(state, best, schema)])

    keys = ["bundle", "share", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out).drop("k")
