import numpy as np
from pyspark.sql import functions as F

from corpusframe.llm import op6_ann as ann
from corpusframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def exact(rows, asked, k):
    out = {}
    for q, vector in asked:
        scored = sorted(((-float(np.dot(vector, v)), i) for i, v in rows if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_query_recall(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r[0], np.array(r[1], float)) for r in ann.usable(table, "vec_id", "embedding").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in QUERIES["op6_ann"](spark, FOLDER).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_strange_rows(spark):
    rows = [(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(50)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [float("nan"), 1.0, 1.0]), (103, [None, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (20, rows[20][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("part", F.lit(1))
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact([(i, np.array(v)) for i, v in rows], [(i, np.array(v)) for i, v in rows if i % 20 == 0], 20)
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert ann.neighbours(few, few).count() == 6


def test_codes_spare_exact_work(spark):
    """Recall and the share of pairs scored exactly, in blocks of two sizes of the given vectors and their jittered copies."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    base = np.array([r[1] for r in ann.usable(table, "vec_id", "embedding").orderBy("vec_id").collect()])
    rng = np.random.default_rng(1)
    for copies in (1, 4):
        vectors = np.concatenate([base + rng.normal(scale=0.1, size=base.shape) * (i > 0) for i in range(copies)])
        ids, queries = np.arange(len(vectors)), vectors[::20]
        packed, lengths, cosines = ann.encode(vectors)
        signs = np.unpackbits(packed, axis=1, count=ann.BITS * base.shape[1]).astype(np.float32) * 2 - 1
        rows, found, _, scored = ann.search_block(queries, ids[::20], vectors, ids, (signs, lengths, cosines))
        products = queries @ vectors.T
        products[np.arange(len(queries)), ids[::20]] = -np.inf
        want = np.argsort(-products, axis=1)[:, : ann.K]
        hit = sum(len(set(found[rows == i]) & set(want[i])) for i in range(len(queries)))
        share = scored / products.size
        print(f"{len(vectors)} vectors: recall {hit / want.size:.3f}, scored exactly {share:.3f}")
        assert hit >= 0.9 * want.size
        assert share < 0.15
