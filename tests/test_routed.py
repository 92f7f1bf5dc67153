import pytest
from pyspark.sql import functions as F

from corpusframe.operators import coverage, fusion, keyword
from corpusframe.plans import model_tables as m

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library(spark):
    return m.questions(spark, FOLDER), m.chunks(spark, FOLDER)


def mixed(asked):
    first = asked.where("question_id < 4")
    broad = F.concat(F.lit("Which documents mention "), "question")
    return first.withColumn("question", F.when(F.col("question_id") < 2, broad).when(F.col("question_id") == 2, F.lit(None)).otherwise(F.col("question")))


def rows(df, *more):
    return sorted(tuple(r) for r in df.select("question_id", "chunk_id", "rank", *more).collect())


def test_each_question_takes_its_way(library):
    asked, chunks = library
    asked = mixed(asked)
    found = fusion.routed_search(asked, chunks, ["semantic", "keyword"], top=5)
    ways = {r.question_id: r.route for r in found.select("question_id", "route").distinct().collect()}
    assert ways == {0: "coverage", 1: "coverage", 2: "ranked", 3: "ranked"}
    broad = coverage.coverage_search(asked.where("question_id < 2"), chunks, budget=5).withColumn("rank", F.col("number"))
    assert rows(found.where("route = 'coverage'"), *fusion.COUNTS) == rows(broad, *fusion.COUNTS)
    plain = fusion.retrieve(asked.where("question_id >= 2"), chunks, ["semantic", "keyword"], top=5)
    assert rows(found.where("route = 'ranked'"), "sources") == rows(plain, "sources")
    assert found.where("route = 'ranked' and documents_matched is not null").count() == 0


def test_compare_equals_arms_run_alone(library):
    asked, chunks = library
    asked = mixed(asked)
    arms = [["semantic"], ["keyword"], ["keyword", "semantic"]]
    together = fusion.compare(asked, chunks, arms, top=3)
    index = keyword.build_index(chunks)
    for arm in arms:
        alone = fusion.routed_search(asked, chunks, arm, index=index, top=3)
        mine = together.where(F.col("composition") == "+".join(fusion.ordered_retrievers(arm)))
        assert rows(mine, "route", "sources") == rows(alone, "route", "sources")


def test_no_question(library):
    asked, chunks = library
    assert fusion.routed_search(asked.limit(0), chunks, ["keyword"]).count() == 0


def test_covered_of_matched(frame):
    runs = frame("question_id int, composition string, answered boolean, latency_ms double, cited_files array<string>, chunk_count int, citation_count int, documents_covered int, documents_matched int", [
        (1, "a", True, 5.0, ["x"], 5, 1, 3, 7), (1, "b", True, 4.0, ["x", "y"], 5, 2, 4, 4), (1, "c", False, 1.0, [], 5, 0, None, None), (2, "a", True, 9.0, [], 2, 0, 2, 1)])
    got = {(r.question_id, r.composition): r for r in fusion.composition_metrics(runs).collect()}
    assert {k: (r.covered, r.fastest) for k, r in got.items()} == {(1, "a"): ("3 of 7", "b"), (1, "b"): ("4", "b"), (1, "c"): (None, "b"), (2, "a"): ("2", "a")}
    assert "covered" not in fusion.composition_metrics(runs.drop("documents_matched")).columns
