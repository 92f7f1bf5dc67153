import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusframe.llm import op3_simhash as simhash
from corpusframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def by_hand(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest id reachable over links of two bits, by comparing all."""
    ids, values = list(prints), np.array(list(prints.values()), np.uint64)
    label = {i: i for i in ids}
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 2) for v in values]
    while True:
        new = {i: min(label[ids[j]] for j in near[k]) for k, i in enumerate(ids)}
        if new == label:
            return label
        label = new


def check(got, texts):
    prints = {i: by_hand(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == groups(prints)


def test_query_equals_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    check(QUERIES["op3_simhash"](spark, FOLDER).collect(), texts)


@pytest.mark.parametrize("shard", [2, 512])
def test_links_of_clusters_and_chains(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    random = np.random.default_rng(3)
    values = {int(v) for v in random.integers(0, 1 << 63, 60)}
    for start in list(values)[:6]:
        value = start
        for bit in random.permutation(64)[:25].tolist():
            value ^= 1 << bit
            values.add(value)
        values |= {start ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in random.integers(0, 64, (60, 3))}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(v,) for v in signed.values()], "print long")
    got = {r.a: r.b for r in simhash._contracted(simhash._links(df)).collect()}
    label = groups({s: v for v, s in signed.items()})
    assert {s: got.get(s, s) for s in signed.values()} == label


@pytest.mark.parametrize("n", [10, 1 << 40, 1 << 60])
def test_masks_miss_no_two_bits(n):
    masks = simhash._masks(n)
    for a in range(64):
        for b in range(64):
            bits = (1 << a) | (1 << b)
            assert any(not (m & (1 << 64) - 1) & bits for m in masks)


def test_strange_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "ÄB c d e"), (8, "äb c d e"), (9, "word " * 200_000), (9, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("x")).withColumn("n", F.lit(1)).withColumn("component_id", F.lit(1))
    got = simhash.components(df).collect()
    assert len(got) == len(rows)
    check(got, dict(rows))
    assert simhash.components(df.limit(0)).count() == 0
    assert simhash.components(spark.createDataFrame([(None, "a"), (4, "a")], "doc_id long, text string")).where("component_id = 4").count() == 2
