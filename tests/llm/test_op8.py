import pytest
from pyspark.sql import functions as F

from corpusframe.llm import op8_mixing as mixing
from corpusframe.llm.queries import ORACLES, QUERIES
from oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"


def by_hand(sizes, weights=(5, 2, 1), cap=3):
    """Shares by repeated re-sharing of what the capped leave."""
    names = sorted(sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    fixed = {}
    while True:
        free = [n for n in names if n not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {n: rest * weight[n] / sum(weight[f] for f in free) for n in free}
        over = [n for n in free if share[n] > cap * sizes[n]]
        if not over:
            return {**fixed, **share}
        fixed.update({n: cap * sizes[n] for n in over})


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 100, "c": 1000}, {"a": 1, "b": 1, "c": 1, "d": 900, "e": 5}, {"a": 7}, {"a": 0, "b": 30},
])
def test_targets(spark, sizes):
    rows = [(name, part) for name, size in sizes.items() for part in (size // 2, size - size // 2)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(by_hand(sizes))


def test_query_equals_its_sql(spark):
    assert differences(spark, connect(FOLDER), QUERIES["op8_mixing"], ORACLES["op8_mixing"], FOLDER) is None


def test_strange_rows(spark):
    rows = [(i, "w " * (1 + i % 9), "a" if i % 3 else None) for i in range(300)] + [(1, None, "b"), (2, "", "c"), (None, "x y", None), (5, "w w w", "a"), (5, "w w w", "a"), (7, "long " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("place", F.lit(2))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 3 * r.size and (r.size > 0 or r.taken == 0) for r in got)
    assert {r.source_size for r in got if r.size == 0} <= {0}
    copies = mixing.mixed(df)
    assert copies.columns == df.columns
    assert copies.count() == sum(r.taken // r.size for r in got if r.size)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed(df.limit(0)).count() == 0


def test_sources_come_near_their_targets(spark):
    sizes = mixing.mix(spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 5}") for i in range(4000)], "doc_id long, text string, source string"))
    for r in sizes.groupBy(F.col("doc_id") % 5, "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 40


def test_main_path_has_no_python(spark):
    plan = mixing.mix(spark.read.parquet(FOLDER + "/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_of_a_text_are_counted_once(spark, capsys):
    rows = [(1, "a", " one\ttwo \x0b\x0c\r\n three\xa0four \x1cfive "), (2, "a", ""), (3, "a", " \n"), (4, None, None), (5, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [r.n for r in df.orderBy("doc_id").select(mixing.word_count(F.col("text")).alias("n")).collect()] == [4, 0, 0, 0, 1]
    mixing.mixed(df).explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(") == 1 and "regexp_count" not in plan and "regexp_extract_all" not in plan
