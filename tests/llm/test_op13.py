import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import op13_negatives as mining
from corpusframe.llm.queries import ORACLES, QUERIES
from oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<double>"


def by_hand(rows, every=100, k=5):
    clean = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in clean:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in clean if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            near = [(-t, n) for t, n, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r, n, -s, t) for r, (t, n) in enumerate(near[:k], 1)]
    return sorted(out)


def check(rows, df, every=100):
    got = mining.mine(df, every)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, every)


def test_query_equals_its_sql(spark):
    assert differences(spark, connect(FOLDER), QUERIES["op13_negatives"], ORACLES["op13_negatives"], FOLDER) is None


def test_strange_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(10)), [round(float(x), 2) for x in rng.normal(size=4)]) for i in range(400)]
    rows += [(1000 + i, i % 10, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]
    rows += [(100, 3, None), (None, 1, [1.0] * 4), (2, None, [1.0] * 4), (200, 1, [float("nan")] * 4), (300, 1, [None, 1.0, 1.0, 1.0]),
             (400, 1, [float("inf")] * 4), (400, 2, [0.0] * 4), (400, 2, [0.0] * 4), (500, 5, [1.0, 2.0]), (501, 5, [1.0, 2.0]), (503, 6, [1.0, 1.9]),
             (600, 0, []), (601, 0, []), (602, 1, []), (100, rows[100][1], rows[100][2]), (-700, 4, [0.25] * 4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("rank", "block", "pack", "width", "place", "numbers", "ids")})
    check(rows, df)
    assert mining.mine(df.limit(0)).count() == 0


def test_many_blocks_packs_and_groups(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("PACK_BYTES", 200), ("ZONE_BYTES", 900), ("BROADCAST_BYTES", 0), ("SAMPLE", 20)):
        monkeypatch.setattr(mining, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    check(rows, spark.createDataFrame(rows, SCHEMA), 10)


def test_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, [float(x) for x in rng.integers(-(1 << 22), 1 << 22, 3)]) for i in range(60)]
    check(rows, spark.createDataFrame(rows, SCHEMA), 5)


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    place = mining.hilbert(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_prune_where_rows_lie_together():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 16))
    rows = mining.whole(np.repeat(centres, 50, 0) + 0.02 * rng.normal(size=(1000, 16))).reshape(20, 50, 16)
    low, high = mining.bounds(rows[:, 0], rows.min(1), rows.max(1))
    found = np.einsum("ad,brd->abr", rows[:, 0], rows)
    assert (low[:, :, None] <= found).all() and (found <= high[:, :, None]).all()
    # An anchor's own block limits its positives; few other blocks can reach that.
    limit = np.sort(found[np.arange(20), np.arange(20)], axis=1)[:, -5]
    assert (high >= limit[:, None]).sum() < 40
