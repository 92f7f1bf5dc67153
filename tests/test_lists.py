import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.config import Config
from corpusframe.operators import lists, vector


def rows_of(hits):
    return sorted((r.question_id, r["rank"], r.chunk_id, r.score) for r in hits.collect())


def clustered(frame, n=600, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    points = centres[rng.integers(12, size=n)] + 0.1 * rng.normal(size=(n, width))
    points[: n // 3] = points[0]
    chunks = [(f"c{i}", f"d{i % 9}", p.tolist()) for i, p in enumerate(points)]
    chunks += [("odd", "d", [1.0, 2.0]), ("none", "d", None), ("empty", "d", []), ("c1", "d1", points[1].tolist())]
    asked = [(i, points[i * 7].tolist()) for i in range(60)] + [(100, [1.0, 2.5]), (101, None), (102, [0.0] * 5)]
    return (frame("chunk_id string, document_id string, embedding array<double>", chunks),
            frame("question_id int, embedding array<double>", asked))


@pytest.mark.parametrize("config", [Config(), Config(block_vectors=40, block_questions=7, max_lists=5), Config(list_sample=3, max_lists=200)])
def test_certified_search_is_the_full_scan(frame, tmp_path, config):
    chunks, asked = clustered(frame)
    index = lists.write_lists(chunks, str(tmp_path / "lists"), config)
    want = rows_of(vector.nearest(asked, chunks, 4))
    assert rows_of(lists.search(asked, index, 4, certified=True, config=config).select("question_id", "rank", "chunk_id", "score")) == want
    assert rows_of(lists.search(asked, index, 4, probes=1, certified=True, config=config)) == want


def test_recall_and_lists_read(spark, frame, tmp_path):
    chunks, asked = clustered(frame)
    index = lists.write_lists(chunks, str(tmp_path / "lists"))
    assert 1 <= index.probes < index.centroids.count()
    hits = lists.search(asked.where("question_id < 3"), index)
    want = rows_of(vector.nearest(asked.where("question_id < 3"), chunks))
    assert len(set(rows_of(hits)) & set(want)) >= 0.9 * len(want)
    read = index.rows.where(F.col("list").isin([r[0] for r in lists._probed(
        asked.where("question_id < 3"), spark.sparkContext.broadcast(lists._Centroids(
            [(r["list"], r["centre"]) for r in index.centroids.collect() if r["list"] >= 0])), index.probes).select("list").distinct().collect()]))
    assert read.count() < index.rows.count()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and "list#" in plan


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, tmp_path, sf):
    vecs = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    chunks = vecs.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), "embedding")
    asked = vecs.select(F.col("vec_id").alias("question_id"), "embedding")
    index = lists.write_lists(chunks, str(tmp_path / "lists"))
    got, want = rows_of(lists.search(asked, index)), rows_of(vector.nearest(asked, chunks))
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert index.probes < index.centroids.count()


def test_nothing_to_search(frame, tmp_path):
    chunks, asked = clustered(frame)
    index = lists.write_lists(chunks.where("false"), str(tmp_path / "none"))
    assert lists.search(asked, index).count() == 0 and lists.search(asked, index, certified=True).count() == 0
    index = lists.write_lists(chunks, str(tmp_path / "all"))
    assert lists.search(asked.where("false"), index).count() == 0


def test_long_vectors_keep_their_distances(frame):
    """Wide and long vectors: the product form cancels, the kept distances must not."""
    rng = np.random.default_rng(2)
    base = 1e4 * rng.normal(size=1536)
    points = [base + 1e-3 * rng.normal(size=1536) for _ in range(40)]
    chunks = frame("chunk_id string, document_id string, embedding array<double>", [(f"{i:02}", "d", p.tolist()) for i, p in enumerate(points)])
    asked = frame("question_id int, embedding array<double>", [(0, points[0].tolist())])
    want = sorted((round(float(((points[0] - p) ** 2).sum()), 9), f"{i:02}") for i, p in enumerate(points))[:5]
    assert [(r.score, r.chunk_id) for r in vector.nearest(asked, chunks).orderBy("rank").collect()] == want


def test_a_question_moves_once_for_lists_beside_each_other():
    rng = np.random.default_rng(4)
    known = [{"list": i, "width": 2, "rows": 100, "shares": 1, "centre": rng.normal(size=2).tolist()} for i in range(100)]
    known.append({"list": 100, "width": 2, "rows": 5000, "shares": 5, "centre": [0.0, 0.0]})
    config = Config(block_vectors=1000, block_questions=50)
    plan = lists._bundles(known, {r["list"]: 400 for r in known}, 500, 4, config)
    assert sorted(p[0] for p in plan) == list(range(101))
    sizes = {}
    for number, bundle, _, blocks in plan:
        sizes.setdefault(bundle, []).append(number)
        assert blocks == (8 if number == 100 else 10)
    assert [100] in sizes.values() and len(sizes) <= 12
    assert all(len(some) <= 10 for some in sizes.values())


def test_few_rows_wait_per_question(frame, tmp_path):
    """All lists of a bundle together leave k rows of a question, not k rows each."""
    chunks, asked = clustered(frame)
    index = lists.write_lists(chunks, str(tmp_path / "lists"), Config(max_lists=200, list_sample=600))
    known = index.centroids.collect()
    # Many questions by their number: bundles are as large as allowed.
    found = lists._inside(asked.where("embedding is not null").withColumn("worst", F.lit(None).cast("double")), index, known,
                          (0, len(known)), 4, Config(block_questions=1))
    assert len(known) > 12 and found.groupBy("question_id").count().agg(F.max("count")).first()[0] <= 4 * 2
