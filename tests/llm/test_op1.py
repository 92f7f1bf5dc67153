import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import op1_quality as quality
from corpusframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", [
    "", " \n ", "a", "a a a a a a", "é ü\x1cx\xa0y b\nb \nb\n\n", "x y z v w q x y z v w", "a b c d e a b c d e f a b c d e",
    "same line\nsame line\n same line\n", "#*$%&|<> <b>", "1 2 " * 9, "퟿ \U0001f600 " * 4,
])
def test_counts(text):
    assert quality.statistics_of(text.encode())[:5] == by_hand(text)


def test_query_counts_and_verdicts(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op1_quality"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        n, chars, symbols, lines, repeats = by_hand(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    passing = [(labels[r.doc_id], r.kept) for r in got if r.doc_id in labels and not r.base_failed]
    good = [k for q, k in passing if q == 1]
    bad = [k for q, k in passing if q == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.4 * len(bad)


def test_a_lone_row_is_separated_first():
    random = np.random.default_rng(0)
    rows = np.concatenate([random.normal(size=(400, 3)), [[30.0, 30, 30]]])
    score = quality.grow(rows, trees=60).score(rows)
    assert score.argmax() == 400
    assert ((score > 0) & (score < 1)).all()


def test_calibration():
    good = np.array([True] * 200 + [False] * 4)
    score = np.concatenate([np.linspace(0, 0.5, 200), [0.4, 0.6, 0.7, 0.8]])
    limit = quality.calibrate(score, good)
    assert (score[good] > limit).mean() <= quality.LOST_GOOD and (score[~good] > limit).sum() == 3
    assert quality.calibrate(score, np.ones(204, bool)) == 1.0


def test_strange_rows(spark):
    rows = [(1, None), (2, ""), (3, "w " * 100_000), (None, "some words"), (4, "a b c d e f g h i j k"), (4, "a b c d e f g h i j k")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("quality", F.lit(3)).withColumn("n_words", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 1), (None, 0), (3, None)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    got = quality.judge(df, labels).collect()
    assert sorted((r.doc_id or 0, r.base_failed, r.kept) for r in got) == [
        (0, True, False), (1, True, False), (2, True, False), (3, True, False), (4, False, True), (4, False, True)]
    assert quality.judge(df.limit(0), labels).count() == 0
    assert quality.judge(df, labels.limit(0)).count() == 6


def test_models_come_from_all_labelled_rows(spark, monkeypatch):
    n = 6_500
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('a b c d e f g h i j k ', id, CASE WHEN id % 9 = 0 THEN ' ## $$ %% && 12' ELSE ' x' END) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 9 = 0 THEN 0 ELSE 1 END AS quality")
    seen = []
    calibrated, telling = quality.calibrated, quality.telling
    monkeypatch.setattr(quality, "calibrated", lambda rows: seen.append(rows.count()) or calibrated(rows))
    monkeypatch.setattr(quality, "telling", lambda rows: seen.append(rows.count()) or telling(rows))
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert seen == [n, n]
    assert sum(kept[i] for i in range(n) if i % 9) >= 0.99 * n * 8 / 9


def test_calibration_over_a_table(spark):
    random = np.random.default_rng(3)
    score, good = np.round(random.random(500), 2), random.random(500) < 0.8
    table = spark.createDataFrame([(bool(g), float(s)) for g, s in zip(good, score)], "good boolean, score double")
    for lost in (0.0, 0.005, 0.3):
        assert quality.calibrated(table, lost) == quality.calibrate(score, good, lost)
    assert quality.calibrated(table.where("good")) == 1.0
