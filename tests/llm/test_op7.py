import pytest
from pyspark.sql import functions as F

from corpusframe.llm import op7_toxicity as toxicity
from corpusframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"
GRAMMAR = toxicity.Grammar({"idiot": 1.0}, {"loweis": 1.0})


def events(text):
    return [toxicity.CLASSES[k] for k, w in GRAMMAR.events(text.split())]


@pytest.mark.parametrize("clause, want", [
    ("what an idiot", [(toxicity.INSULT, False, "plain")]),
    ("you are an idiot", [(toxicity.INSULT, True, "plain")]),
    ("idiot is what i call you", []),
    ("never an idiot", [(toxicity.INSULT, False, "negated")]),
    ("not one two three four idiot", [(toxicity.INSULT, False, "plain")]),
    ("she said you idiot", [(toxicity.INSULT, True, "reported")]),
    ("i will kill you", [(toxicity.THREAT, True, "plain")]),
    ("loweischen", [(toxicity.INSULT, False, "plain")]),
    ("nothing here", []),
])
def test_clauses(clause, want):
    got = events(clause)
    assert got == (want or got) if want else all(k[2] == "plain" for k in got)


def test_scopes_end_with_the_clause():
    one = GRAMMAR.score(GRAMMAR.features("he said so. idiot")[None])[0]
    assert one == pytest.approx(GRAMMAR.score(GRAMMAR.features("idiot")[None])[0])
    assert GRAMMAR.score(GRAMMAR.features("not an idiot")[None])[0] < one
    assert GRAMMAR.score(GRAMMAR.features("you idiot")[None])[0] > one


def test_held_out_quality(spark):
    got = QUERIES["op7_toxicity"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    table = {(r.toxic, r.predicted): r["count"] for r in got.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    found, missed, false = table[1, 1], table.get((1, 0), 0), table.get((0, 1), 0)
    assert found / (found + missed) > 0.8 and found / (found + false) > 0.85


def test_strange_rows(spark):
    own = lambda i: " ".join(chr(97 + i // 26) + chr(97 + i % 26) + end for end in ("ra", "lo", "mi", "tu"))
    rows = [(i, own(i), 0) for i in range(90)] + [(100 + i, f"{own(100 + i)} idiot {own(200 + i)}", 1) for i in range(90)]
    odd = [(201, None), (202, ""), (None, "you idiot"), (203, "clean. " * 50_000 + "idiot"), (100, "you idiot")]
    df = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("marks", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (201, 0), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit(""))
    got = toxicity.rate(df, labels).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[201].score == by[202].score and by[201].predicted == 0 and by[None].predicted == 1
    assert toxicity.rate(df.limit(0), labels).count() == 0
    assert toxicity.rate(df, labels.limit(0)).count() == len(rows + odd)
