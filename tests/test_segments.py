import random

import pytest
from pyspark.sql import functions as F

from corpusframe.config import Config
from corpusframe.operators import keyword, segments

WORDS = "leave days annual sick probation months contract pay notice holiday remote office desk travel cost".split()


def library(frame, seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = 0 if i % 23 == 0 else rng.randrange(1, 30)
        words = [WORDS[min(int(rng.expovariate(0.35)), len(WORDS) - 1)] for _ in range(size)]
        rows.append((f"{i % 11}:{i}", f"{i % 11}", " ".join(words) + (" rare" if i % 50 == 3 else "")))
    return frame("chunk_id string, document_id string, content string", rows)


def asked(frame):
    rows = [(1, "annual leave days days?"), (2, "rare"), (3, "unknown words"), (4, "!!"), (5, " ".join(WORDS)), (6, "rare leave"), (7, None)]
    return frame("question_id int, question string", rows)


def rows_of(hits):
    return sorted((r.question_id, r["rank"], r.chunk_id, r.document_id, round(r.score, 5)) for r in hits.collect())


CONFIGS = [Config(), Config(resident_terms=0), Config(resident_terms=0, hot_rows=1), Config(bm25_epsilon=-0.25)]


@pytest.mark.parametrize("config", CONFIGS)
def test_search_equals_scoring_all(frame, tmp_path, monkeypatch, config):
    monkeypatch.setattr(segments, "BLOCK", 5)
    chunks = library(frame)
    index = segments.write_index(chunks, str(tmp_path / "index"), config)
    want = keyword.build_index(chunks, config)
    for top in (1, 5, 1000):
        assert rows_of(segments.search(asked(frame), index, top, config)) == rows_of(keyword.keyword_search(asked(frame), want, top, Config(resident_terms=0, bm25_epsilon=config.bm25_epsilon)))
    scopes = asked(frame).withColumn("scope", F.when(F.col("question_id") < 6, F.array(F.lit("3"), F.lit("7"))))
    assert rows_of(segments.search(scopes, index, 3, config)) == rows_of(keyword.keyword_search(scopes, want, 3, config)) != []


def test_in_place_equals_joined(frame, monkeypatch):
    monkeypatch.setattr(keyword, "_CELLS", 40)
    monkeypatch.setattr(keyword, "_WAITING", 3)
    index = keyword.build_index(library(frame))
    stored = keyword.KeywordIndex(index.counts, index.terms, index.corpus)
    scopes = asked(frame).withColumn("scope", F.when(F.col("question_id") % 2 == 0, F.array(F.lit("3"), F.lit("no"))))
    for questions in (asked(frame), scopes):
        want = rows_of(keyword.keyword_search(questions, index, 4, Config(resident_terms=0)))
        assert rows_of(keyword.keyword_search(questions, index, 4)) == want == rows_of(keyword.keyword_search(questions, stored, 4))


def test_selective_questions_need_few_blocks(frame, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 5)
    index = segments.write_index(library(frame, n=400), str(tmp_path / "index"))
    one = frame("question_id int, question string", [(1, "contract"), (2, "office travel")])
    needed = segments.needed_blocks(one, index, index.statistics(), 2)
    terms = segments._weights(one, index.statistics(), "question").select("question_id", "term")
    every = index.blocks.select("term", "level").distinct().join(terms, "term")
    assert 0 < needed.count() < every.count()


def test_segments_tombstones_and_merging(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    chunks = library(frame)
    old = chunks.where("document_id <> '3'")
    live = chunks.where("document_id <> '4'").unionByName(frame("chunk_id string, document_id string, content string", [("n:0", "n", ""), ("n:1", "n", "rare leave")]))
    index = segments.write_index(old, path)
    assert segments.changes(index, live).groupBy("change").count().count() == 2
    grown = segments.refresh(index, live)
    assert grown.segments == (0, 1)
    # Nothing is new the second time, chunks without a token included.
    assert segments.changes(grown, live).count() == 0 and segments.refresh(grown, live).segments == (0, 1)
    back = segments.refresh(grown, chunks)  # what had gone comes back, what was new goes
    assert back.segments == (0, 1, 2)
    for state, have in ((index, old), (grown, live), (back, chunks), (segments.merged(back), chunks), (segments.read_index(spark, path), chunks)):
        want = keyword.build_index(have)
        assert rows_of(segments.search(asked(frame), state, 4)) == rows_of(keyword.keyword_search(asked(frame), want, 4))
        key = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.collect())
        assert key(state.statistics().terms) == key(want.terms)
    assert segments.read_index(spark, path).segments == (3,)
    empty = segments.refresh(segments.read_index(spark, path), chunks.where("false"))
    assert segments.search(asked(frame), empty, 4).count() == 0


def test_a_search_moves_a_posting_once(frame, tmp_path, monkeypatch):
    """However many questions need it; repeated chunks add up as before."""
    chunks = library(frame, n=60)
    index = segments.write_index(chunks.unionByName(chunks.where("document_id = '3'")), str(tmp_path / "index"))
    seen = []
    scored = keyword._scored_in_place
    monkeypatch.setattr(keyword, "_scored_in_place", lambda rows, *more: seen.append(rows) or scored(rows, *more))
    many = frame("question_id int, question string", [(i, " ".join(WORDS)) for i in range(30)])
    hits = segments.search(many, index, 3)
    moved = seen[-1].selectExpr("sum(size(gains)) AS n").first().n
    assert moved <= index.blocks.selectExpr("sum(n) AS n").first().n
    assert len({(r["rank"], r.chunk_id, r.score) for r in hits.collect()}) == 3
    far = segments.search(many, index, 3, Config(resident_terms=0))
    assert rows_of(far) == rows_of(hits)


def test_counts_and_blocks_are_laid_in_batches(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 3)
    monkeypatch.setattr(segments, "TEXT", 40)
    odd = [("x:1", "x", None), ("x:2", "x", " \n"), (None, None, "Leave LEAVE İstanbul 4K Straße"), ("x:2", "x", "leave-leaveéleave 日本 leave"), ("x:3", "x", "ſ ΑΣ a" + " b2" * 50)]
    chunks = library(frame, n=60).unionByName(frame("chunk_id string, document_id string, content string", odd)).coalesce(2)
    order = lambda rows: sorted(map(str, rows))
    counted = segments._counted(chunks)
    assert order(counted.collect()) == order(keyword.counted(chunks).collect())
    assert segments._counted(chunks.limit(0)).count() == 0
    index = segments.write_index(chunks, str(tmp_path / "index"))
    blocks = index.blocks.collect()
    held = [(b.term, p.chunk_id, p.document_id, p.tf, p.dl) for b in blocks for p in b.postings]
    assert order(held) == order(tuple(r) for r in keyword.postings_of(chunks).collect())
    for b in blocks:
        assert len(b.postings) == b.n <= 3 and b.max_tf == max(p.tf for p in b.postings) and b.min_dl == min(p.dl for p in b.postings)
    assert {b.bucket for b in blocks} <= set(range(segments.BUCKETS)) and len({b.level for b in blocks}) > 1
