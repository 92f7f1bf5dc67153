import numpy as np
from pyspark.sql import functions as F

from corpusframe.llm import op9_langid as langid
from corpusframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_presence_counts_no_gram_across_texts():
    flags, lettered = langid.presence(["ab", "", "12", "ab", "Ünï"])
    alone = [langid.presence([t])[0][0] for t in ["ab", "", "12", "ab", "Ünï"]]
    assert (flags == np.array(alone)).all()
    assert lettered.tolist() == [True, False, False, True, True]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op9_langid"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    held = got.where("held_out AND lang IS NOT NULL")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert got.where("score < 0 OR score > 1").count() == 0


def test_strange_rows(spark):
    rows = [(i, f"the and of thing {i}", "en") for i in range(30)] + [(100 + i, f"der und die ung {i}", "de") for i in range(30)]
    odd = [(201, None, "en"), (202, "", None), (203, "1234 !!", "de"), (None, "the and of", None), (204, "der und die " * 30_000, None), (1, "the and of thing 1", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("bits", F.lit(1))
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(df).collect()}
    assert {(201, "und"), (202, "und"), (203, "und"), (None, "en"), (204, "de"), (1, "en")} <= got
    assert langid.identify(df).count() == len(rows + odd)
    assert langid.identify(df.limit(0)).count() == 0
    untaught = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
