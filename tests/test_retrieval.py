import math
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusframe.config import Config
from corpusframe.functions import text
from corpusframe.operators import coverage, evidence, fusion, hierarchy, keyword, reuse, routing, vector

BLOCKS = Config(resident_questions=0, block_questions=7, block_vectors=40)


def okapi(corpus, query):
    """Scores by the textbook formula: corpus {id: tokens}."""
    n, avgdl = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = Counter(t for tokens in corpus.values() for t in set(tokens))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return {
        i: sum(idf.get(t, 0) * tokens.count(t) * 2.5 / (tokens.count(t) + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl)) for t in query)
        for i, tokens in corpus.items()
    }


TEXTS = {
    "a:0": "annual leave is 22 days", "a:1": "sick leave is 12 days days", "b:0": "probation lasts six months",
    "b:1": "", "c:0": "expenses need a receipt and leave a trace",
}


def chunk_frame(frame, texts=TEXTS):
    return frame("chunk_id string, document_id string, content string", [(k, k.split(":")[0], v) for k, v in texts.items()])


@pytest.mark.parametrize("config", [Config(), Config(resident_terms=0), Config(resident_terms=0, hot_rows=1)])
def test_bm25_equals_the_formula(frame, config):
    questions = frame("question_id int, question string", [(1, "Annual leave days days?"), (2, "probation"), (3, "nothing here"), (4, "!!")])
    index = keyword.build_index(chunk_frame(frame), config)
    got = {(r.question_id, r.chunk_id): r.score for r in keyword.keyword_search(questions, index, 10, config).collect()}
    corpus = {k: v.split() for k, v in TEXTS.items()}
    want = {}
    for number, query in ((1, "annual leave days days".split()), (2, ["probation"]), (3, ["nothing", "here"])):
        want.update({(number, i): round(s, 6) for i, s in okapi(corpus, query).items() if s > 0})
    assert got == pytest.approx(want)


def test_keyword_scope_fills_top_k_after_scoping(frame):
    questions = frame("question_id int, question string, scope array<string>", [(1, "leave days", ["c"]), (2, "leave days", None), (3, "leave", [])])
    hits = keyword.keyword_search(questions, keyword.build_index(chunk_frame(frame)), 1)
    assert {(r.question_id, r.document_id) for r in hits.collect()} >= {(1, "c")}
    assert {r.question_id for r in hits.collect()} == {1, 2, 3}
    # The scope never changes a score.
    free = keyword.keyword_search(questions.drop("scope"), keyword.build_index(chunk_frame(frame)), 9)
    scores = {(r.question_id, r.chunk_id): r.score for r in free.collect()}
    assert all(scores[r.question_id, r.chunk_id] == r.score for r in hits.collect())


def test_refresh_equals_rebuild(frame):
    old = chunk_frame(frame, {k: v for k, v in TEXTS.items() if k != "b:0"} | {"z:0": "gone now", "z:1": ""})
    index = keyword.build_index(old)
    assert keyword.scope_filter(old, ["a", "a"]).count() == 2 and keyword.scope_filter(old, []).count() == old.count()
    live = chunk_frame(frame)
    changes = {(r.chunk_id, r.change) for r in keyword.index_changes(index, live).collect()}
    # A chunk without a token is known like any other.
    assert changes == {("b:0", "added"), ("z:0", "removed"), ("z:1", "removed")}
    key = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.collect())
    again = keyword.refresh_index(index, live)
    assert key(again.terms) == key(keyword.build_index(live).terms)
    assert keyword.index_changes(again, live).count() == 0


def brute(questions, chunks, k, scope=None, sections=None):
    out = {}
    for q, v in questions.items():
        rows = [(round(float(((np.array(v) - np.array(c)) ** 2).sum()), 9), i) for i, (c, doc, sec) in chunks.items()
                if len(c) == len(v) and (not scope or not scope[q] or doc in scope[q]) and (not sections or not sections[q] or sec in sections[q])]
        out[q] = [i for _, i in sorted(rows)[:k if isinstance(k, int) else k[q]]]
    return out


@pytest.mark.parametrize("config", [Config(), BLOCKS])
def test_nearest_equals_brute_force(frame, config):
    rng = np.random.default_rng(5)
    chunks = {f"c{i:03d}": (rng.integers(0, 3, 6).astype(float).tolist(), f"d{i % 7 if i > 60 else 0}", f"s{i % 3}") for i in range(180)}
    chunks["wide"] = ([1.0] * 7, "d0", "s0")
    questions = {i: rng.integers(0, 3, 6).astype(float).tolist() for i in range(25)} | {99: [1.0] * 7, 100: [0.0] * 5}
    scope = {q: ([] if q % 3 == 0 else [f"d{q % 7}", "d2"]) for q in questions}
    sections = {q: (None if q % 2 else ["s1", "s2"]) for q in questions}
    k = {q: 1 + q % 9 for q in questions}
    left = frame("question_id int, embedding array<float>, scope array<string>, section_scope array<string>, k int",
                 [(q, v, scope[q], sections[q], k[q]) for q, v in questions.items()])
    right = frame("chunk_id string, embedding array<float>, document_id string, section_id string", [(i, *v) for i, v in chunks.items()]).repartition(5)

    def got(df):
        rows = {q: [] for q in questions}
        for r in df.orderBy("question_id", "rank").collect():
            rows[r.question_id].append(r.chunk_id)
        return rows

    assert got(vector.nearest(left.select("question_id", "embedding"), right, 4, config=config)) == brute(questions, chunks, 4)
    assert got(vector.nearest(left.drop("section_scope", "k"), right, 4, config=config)) == brute(questions, chunks, 4, scope)
    assert got(vector.nearest(left, right, config=config)) == brute(questions, chunks, k, scope, sections)


def test_identical_vectors_keep_k_by_id(frame):
    """A group of copies as large as the table: ties fall to the id, and no one is dropped."""
    rows = [(f"c{i:05d}", "d", [0.1, 0.2, 0.3]) for i in range(3000)]
    chunks = frame("chunk_id string, document_id string, embedding array<double>", rows).repartition(6)
    hits = vector.nearest(frame("question_id int, embedding array<double>", [(1, [0.1, 0.2, 0.3])]), chunks, 4)
    assert [(r.chunk_id, r.score) for r in hits.orderBy("rank").collect()] == [(f"c{i:05d}", 0.0) for i in range(4)]


def test_empty_sides_and_max_distance(frame):
    questions = frame("question_id int, embedding array<double>", [(1, [0.0, 0.0])])
    none = frame("chunk_id string, document_id string, embedding array<double>", [])
    assert vector.nearest(questions, none).count() == 0
    assert vector.nearest(questions.where("false"), none.unionByName(none)).count() == 0
    chunks = frame("chunk_id string, document_id string, embedding array<double>", [("a", "d", [1.0, 0.0]), ("b", "d", [3.0, 0.0])])
    assert [r.chunk_id for r in vector.semantic_search(questions, chunks, 5, Config(max_distance=1.0)).collect()] == ["a"]


def ranked(frame, rows, question=1):
    return frame("question_id int, chunk_id string, document_id string, score double, rank int",
                 [(question, c, c[0], float(s), i + 1) for i, (c, s) in enumerate(rows)])


def test_rrf_prefers_agreement(frame):
    got = fusion.rrf_fuse(ranked(frame, [("a", .1), ("b", .2)]), ranked(frame, [("b", 9), ("c", 8)]), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]
    b = got[0]
    assert (b.semantic_rank, b.keyword_rank, b.score, b.sources, b.fused_score) == (2, 1, .2, ["semantic", "keyword"], round(1 / 61 + 1 / 62, 6))
    same = fusion.rrf_fuse(ranked(frame, [("x", .1)]), ranked(frame, [("x", 4)])).first()
    assert same.fused_score == round(2 / 61, 6)
    # Equal contributions: the dense row comes first.
    tie = fusion.rrf_fuse(ranked(frame, [("z", .3)]), ranked(frame, [("a", 3)])).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["z", "a"]


def test_rerank_breaks_ties_by_agreement_then_score(frame):
    hits = frame("question_id int, chunk_id string, document_id string, score double, rank int, fused_score double, sources array<string>", [
        (1, "a", "d", .2, 1, .03, ["semantic"]), (1, "b", "d", .9, 2, .03, ["semantic", "keyword"]),
        (1, "c", "d", .1, 3, .03, ["semantic"]), (1, "e", "d", None, 4, .03, ["keyword"]), (1, "f", "d", 5.0, 5, .05, ["keyword"])])
    assert [r.chunk_id for r in fusion.rerank(hits, 4).orderBy("rank").collect()] == ["f", "b", "c", "a"]


def test_hierarchical_rows_continue_the_dense_list(frame):
    semantic, tree = ranked(frame, [("a", .1), ("b", .2)]), ranked(frame, [("b", .25), ("c", .3)])
    sparse = ranked(frame, [("c", 7)])
    got = {r.chunk_id: r for r in fusion.combine(semantic, tree, sparse, 8, 5).collect()}
    # b counts at dense positions 2 and 3 and shows the later one.
    assert got["b"].fused_score == round(1 / 62 + 1 / 63, 6) and got["b"].semantic_rank == 3 and got["b"].score == .25
    assert got["c"].fused_score == round(1 / 64 + 1 / 61, 6)
    alone = fusion.combine(semantic, tree, sparse.where("false"), 8, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.sources[0]) for r in alone] == [("a", "semantic"), ("b", "semantic"), ("b", "hierarchical")]


def test_merge_tools_ranks_each_list_alone(frame):
    rows = frame("tool_no int, question_id int, chunk_id string, document_id string, score double, rank int, sources array<string>, semantic_rank int, keyword_rank int", [
        (0, 1, "a", "d", .1, 1, ["semantic"], 1, None), (0, 1, "b", "d", .2, 2, ["semantic"], 2, None), (1, 1, "b", "d", 5.0, 1, ["keyword"], None, 1)])
    got = fusion.merge_tools(rows).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b"]
    assert got[1].fused_score == round(1 / 62 + 1 / 61, 6) and got[1].score == .2 and got[1].keyword_rank == 1


def coverage_hits(frame, docs):
    rows, rank = [], 0
    for doc, scores in docs.items():
        for n, s in enumerate(scores):
            rank += 1
            rows.append((1, f"{doc}{n}", doc, s, rank))
    return frame("question_id int, chunk_id string, document_id string, score double, rank int", rows)


@pytest.mark.parametrize("budget, chunks, documents", [(2, 2, 2), (5, 5, 4), (None, 8, 4), (100, 8, 4)])
def test_coverage_spends_its_budget_on_breadth(frame, budget, chunks, documents):
    hits = coverage_hits(frame, {d: [.1 + i / 10, .2 + i / 10, .3 + i / 10] for i, d in enumerate("abcd")})
    got = coverage.group_by_document(hits, budget).orderBy("number").collect()
    assert len(got) == chunks and got[0].documents_matched == 4 and got[0].documents_covered == documents
    assert [r.chunk_id for r in got[:2]] == ["a0", "b0"]


def test_coverage_orders_by_best_score_with_nulls_last(frame):
    hits = coverage_hits(frame, {"a": [.10, .11, .12, .13], "b": [.50], "c": [None]})
    assert [r.chunk_id for r in coverage.group_by_document(hits).orderBy("number").collect()] == ["a0", "b0", "c0", "a1"]
    few = coverage.group_by_document(hits, config=Config(coverage_documents=1)).collect()
    assert {r.chunk_id for r in few} == {"a0", "a1"} and few[0].documents_matched == 3


def library(frame):
    docs = frame("document_id string, filename string, summary string, content string, status string", [
        ("a", "leave.md", "annual leave rules", "x", "READY"), ("b", "pay.md", None, "salary and leave", "READY"),
        ("c", "travel.md", "trips", "x", "READY"), ("d", "leave2.md", "annual leave leave leave", "x", "FAILED"), ("e", "other.md", "misc", "x", "READY")])
    chunks = frame("chunk_id string, document_id string, section_id string, content string, embedding array<double>", [
        ("a:0", "a", "s1", "leave days", [0.0, 0.1]), ("a:1", "a", "s2", "notice", [0.9, 0.9]), ("b:0", "b", "s2", "salary", [0.2, 0.2]),
        ("b:1", "b", None, "leave", [0.4, 0.4]), ("c:0", "c", "s1", "trips", [0.0, 0.0])])
    return docs, chunks


def test_documents_rank_with_zero_scores_and_scope(frame):
    docs, _ = library(frame)
    plain = frame("question_id int, question string", [(1, "annual leave"), (2, "zzz")])
    got = {q: [r.document_id for r in hierarchy.rank_documents(plain, docs).where(f"question_id = {q}").orderBy("rank").collect()] for q in (1, 2)}
    assert got == {1: ["a", "b", "c"], 2: ["a", "b", "c"]}
    scoped = frame("question_id int, question string, scope array<string>", [(1, "annual leave", ["e", "c", "b", "a", "d"]), (2, "trips", None)])
    rows = hierarchy.rank_documents(scoped, docs).orderBy("question_id", "rank").collect()
    assert [r.document_id for r in rows if r.question_id == 1] == ["a", "b", "c", "e"]
    assert [r.document_id for r in rows if r.question_id == 2][0] == "c"


def test_documents_that_all_match_badly_rank_below_unmatched_ones(frame):
    """Terms in nearly every document weigh below zero; later unmatched documents win."""
    rows = [(f"d{i:02d}", "x.md", "same words", "", "READY") for i in range(9)] + [("e0", "x.md", "words", "", "READY"), ("e1", "x.md", "words", "", "READY")]
    docs = frame("document_id string, filename string, summary string, content string, status string", rows)
    top = hierarchy.rank_documents(frame("question_id int, question string", [(1, "same")]), docs).orderBy("rank").collect()
    corpus = {r[0]: ["x", "md", *r[2].split()] for r in rows}
    want = sorted(okapi(corpus, ["same"]).items(), key=lambda t: (-round(t[1], 6), t[0]))[:3]
    assert [r.document_id for r in top] == [w[0] for w in want]


def test_hierarchy_narrows(frame):
    docs, chunks = library(frame)
    questions = frame("question_id int, question string, embedding array<double>", [(1, "annual leave", [0.0, 0.0])])
    documents = frame("question_id int, document_id string", [(1, "a"), (1, "b")])
    sections = hierarchy.select_sections(questions, chunks, documents, Config(max_sections=2)).orderBy("rank").collect()
    assert [(s.document_id, s.section_id) for s in sections] == [("a", "s1"), ("b", "s2")]
    chosen = frame("question_id int, document_id string, section_id string", [(1, "a", "s1"), (1, "b", "s2")])
    loose = [r.chunk_id for r in hierarchy.retrieve_in_sections(questions, chunks, chosen).orderBy("rank").collect()]
    strict = [r.chunk_id for r in hierarchy.retrieve_in_sections(questions, chunks, chosen, strict=True).orderBy("rank").collect()]
    assert loose == ["a:0", "b:0", "a:1"] and strict == ["a:0", "b:0"]
    whole = frame("question_id int, document_id string, section_id string", [(1, "b", "whole-document")])
    assert [r.chunk_id for r in hierarchy.retrieve_in_sections(questions, chunks, whole).orderBy("rank").collect()] == ["b:0", "b:1"]
    hits = hierarchy.hierarchical_search(questions, docs, chunks, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in hits] == ["c:0", "a:0"]


def test_coverage_search_lets_keywords_qualify_documents(frame):
    docs, chunks = library(frame)
    questions = frame("question_id int, question string, embedding array<double>", [
        (1, "Which documents mention leave?", [0.0, 0.0]), (2, "Which documents mention zzz?", [0.0, 0.0])])
    got = coverage.coverage_search(questions, chunks, budget=5).collect()
    one = [r for r in got if r.question_id == 1]
    assert {r.document_id for r in one} == {"a", "b"} and one[0].documents_excluded == 1 and one[0].documents_dropped == 0
    assert {r.document_id for r in got if r.question_id == 2} == {"a", "b", "c"}
    loose = coverage.coverage_search(questions, chunks, budget=1, config=Config(require_keyword_match=False)).where("question_id = 1").collect()
    assert len(loose) == 1 and loose[0].documents_dropped == 2


def test_grouped_context(frame):
    hits = frame("question_id int, number int, filename string, content string", [(1, 1, "b.md", "one"), (1, 2, "a.md", "two"), (1, 3, "b.md", "three")])
    assert coverage.grouped_context(hits).first().context == (
        "2 document(s) are listed below.\n\n=== DOCUMENT: b.md ===\n[1] one\n[3] three\n\n=== DOCUMENT: a.md ===\n[2] two")


def test_evidence(frame):
    questions = frame("question_id int, question string", [(1, "Which documents mention probation period length?"), (2, "what is it"), (3, "quantum physics")])
    hits = frame("question_id int, content string, section_path string, filename string", [
        (1, "Probation applies.", "Period", "a.md"), (1, "nothing", None, "b.md"), (3, "leave", None, "c.md")])
    rows = {r.question_id: r for r in evidence.evidence_band(evidence.keyword_overlap(questions, hits)).collect()}
    assert rows[1].overlap == pytest.approx(2 / 3) and rows[1].method == "needs_model" and rows[1].sufficient is None
    assert rows[2].overlap == 1.0 and rows[2].method == "empty" and rows[2].sufficient is False
    assert rows[3].overlap == 0.0 and rows[3].method == "lexical" and rows[3].sufficient is False
    topic = evidence.on_topic(questions, frame("question_id int, score double, semantic_rank int, url string", [
        (1, 0.9, 1, None), (2, 0.8, None, None), (2, 0.5, 1, "http://x"), (3, 1.2, 1, None)]))
    assert {r.question_id: r.on_topic for r in topic.collect()} == {1: True, 2: False, 3: False}


def test_compositions(frame):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    one = frame("i int", [(1,)]).select(
        fusion.composition_id(a("keyword", "semantic"), F.lit(False), F.lit(True), a()).alias("plain"),
        fusion.composition_id(a("hierarchical", "semantic"), F.lit(True), F.lit(True), a("web_search", "calculate")).alias("agent"),
        fusion.composition_id(a("keyword"), F.lit(True), F.lit(False), a()).alias("direct"),
        fusion.composition_id(a(), F.lit(False), F.lit(True), a()).alias("nothing"),
        fusion.composition_id(a("magic"), F.lit(False), F.lit(True), a()).alias("unknown"),
        fusion.composition_family(a("keyword", "semantic"), F.lit(False)).alias("family"),
        fusion.allowed_tools(a("keyword", "semantic"), a("web_search")).alias("tools")).first()
    assert (one.plain, one.agent, one.direct) == ("semantic+keyword", "agent[calculate,web_search]:semantic+hierarchical", "agent-direct:keyword")
    assert one.nothing is None and one.unknown is None and one.family == "hybrid"
    assert one.tools == ["semantic_search", "keyword_search", "hybrid_search", "aggregate_search", "web_search"]
    with pytest.raises(ValueError):
        fusion.ordered_retrievers([])


def test_routes_and_plans(frame):
    asked = frame("question_id int, question string, later boolean", [
        (1, "thanks!", True), (2, "Which documents mention leave?", True), (3, "what about sick leave?", True), (4, "what about sick leave?", False)])
    routes = {r.question_id: r.route for r in routing.question_router(asked, has_history="later").collect()}
    assert routes == {1: "smalltalk", 2: "library_wide", 3: "follow_up", 4: "ranked"}
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    full = a("semantic_search", "keyword_search", "hybrid_search", "aggregate_search", "web_search")
    plan = lambda q, n, allowed, pending: frame("i int", [(1,)]).select(
        routing.rule_plan(F.lit(q), F.lit(n), allowed, F.lit(pending)).alias("p")).first().p
    assert plan("Which documents mention x?", 1, full, True) == ["aggregate_search"]
    assert plan("what is x in the handbook", 0, full, False) == ["hybrid_search"]
    assert plan("what is x", 1, full, True) == ["web_search", "hybrid_search"]
    assert plan("what is x", 0, a("keyword_search", "aggregate_search"), False) == ["keyword_search", "aggregate_search"]


def test_cosine_reuse(frame):
    from datetime import datetime, timedelta

    now = datetime(2026, 5, 1)
    cache = frame("scope string, entry string, question string, embedding array<double>, stored_at timestamp, ttl_seconds int", [
        ("s", "e1", "leave?", [1.0, 0.0, 0.0], now, 60), ("s", "wide", "w", [1.0] * 5, now, 60), ("t", "e2", "other", [0.0, 1.0, 0.0], now, 60)])
    asked = frame("question_id int, scope string, embedding array<double>", [
        (1, "s", [.99, .1, 0.0]), (2, "s", [.86, .51, 0.0]), (3, "t", [.99, .1, 0.0]), (4, "s", [0.0, 0.0, 0.0]), (5, "u", [1.0, 0.0, 0.0])])
    none = frame("question_id int", [])
    hits = reuse.reuse_similar(asked, cache, none).collect()
    assert [(r.question_id, r.entry, r.cached_question) for r in hits] == [(1, "e1", "leave?")] and hits[0].similarity == pytest.approx(.9949, abs=1e-4)
    assert reuse.reuse_similar(asked, cache, none, Config(similarity_threshold=1.0)).count() == 0
    assert reuse.reuse_similar(asked, cache, frame("question_id int", [(1,)])).count() == 0
    assert {r.entry for r in reuse.best_match(asked, cache, Config(resident_questions=0)).collect()} == {"e1", "e2"}
    exact = frame("question_id int, entry string, asked_at timestamp", [(1, "e1", now + timedelta(seconds=59)), (2, "e1", now + timedelta(seconds=60)), (3, "zz", now)])
    assert [r.question_id for r in reuse.reuse_exact(exact, cache).collect()] == [1]
    changes = frame("changed_at timestamp", [(now,)])
    assert reuse.invalidate(cache, changes).count() == 0 and reuse.invalidate(cache, changes.where("false")).count() == 3


def test_digests_ignore_order_and_spacing(frame):
    df = frame("q string, ids array<string>", [("What  is it?", ["b", "a"]), ("what is it? ", ["a", "b"]), ("what is it?", None)])
    scope = reuse.scope_digest(F.lit("semantic"), F.lit(5), F.col("ids"))
    rows = df.select(scope.alias("s"), reuse.entry_digest(F.col("q"), scope).alias("e")).collect()
    assert rows[0] == rows[1] and rows[0].s != rows[2].s


def test_similar_reuse_keeps_the_newest_living_version(frame):
    cache = frame(
        "scope string, entry string, question string, embedding array<double>, stored_at timestamp, ttl_seconds int",
        [("s", "e", "old", [1.0, 0.0], datetime(2026, 1, 1), 60), ("s", "e", "new", [1.0, 0.0], datetime(2026, 1, 2), 60)])
    asked = frame(
        "question_id int, scope string, embedding array<double>, asked_at timestamp",
        [(1, "s", [1.0, 0.0], datetime(2026, 1, 2, 0, 0, 30)), (2, "s", [1.0, 0.0], datetime(2026, 2, 1))])
    none = frame("question_id int", [])
    assert [(r.question_id, r.cached_question) for r in reuse.reuse_similar(asked, cache, none).collect()] == [(1, "new")]


@pytest.mark.parametrize("kept", [1, 3, 500])
def test_similar_reuse_sees_the_cache_as_of_asking(frame, kept):
    import random
    from datetime import timedelta

    rng, start = random.Random(kept), datetime(2026, 1, 1)
    at = lambda: start + timedelta(seconds=rng.randrange(400), microseconds=rng.choice([0, 0, 1]))
    angle = lambda: [rng.uniform(-1, 1), rng.uniform(-1, 1)]
    cache = [(rng.choice("st"), f"e{rng.randrange(9)}", f"q{i}", angle(), at(), rng.choice([0, 30, 60, 5000])) for i in range(80)]
    asked = [(i, rng.choice("stu"), angle(), at()) for i in range(60)] + [(98, "s", [1.0, 0.0], start - timedelta(1)), (99, "s", [1.0, 0.0], start + timedelta(1)), (100, "s", [1.0, 0.0], cache[0][4])]

    def by_hand(scope, vector, now):
        newest = {}
        for row in sorted((r for r in cache if r[0] == scope and r[4] <= now), key=lambda r: (r[4], [-ord(c) for c in r[2]])):
            newest[row[1]] = row
        living = sorted((r for r in newest.values() if now < r[4] + timedelta(seconds=r[5])), key=lambda r: (-r[4].timestamp(), r[1]))[:kept]
        cos = lambda r: sum(a * b for a, b in zip(vector, r[3])) / (sum(a * a for a in vector) * sum(b * b for b in r[3])) ** .5
        best = max(living, key=cos, default=None)
        return None if best is None or cos(best) < .2 else (best[1], best[2])

    want = {i: hit for i, scope, vector, now in asked if (hit := by_hand(scope, vector, now))}
    got = reuse.reuse_similar(
        frame("question_id int, scope string, embedding array<double>, asked_at timestamp", asked),
        frame("scope string, entry string, question string, embedding array<double>, stored_at timestamp, ttl_seconds int", cache),
        frame("question_id int", []), Config(similarity_threshold=.2, cache_candidates=kept)).collect()
    assert {r.question_id: (r.entry, r.cached_question) for r in got} == want and len(got) == len(want) > 5


def test_similar_reuse_needs_lifetimes(frame):
    cache = frame("scope string, entry string, question string, embedding array<double>, stored_at timestamp", [])
    asked = frame("question_id int, scope string, embedding array<double>, asked_at timestamp", [])
    with pytest.raises(ValueError):
        reuse.reuse_similar(asked, cache, frame("question_id int", []))
    with pytest.warns(UserWarning):
        reuse.reuse_similar(asked.drop("asked_at"), cache, frame("question_id int", []))


def test_vectors_meet_in_slices(frame, monkeypatch):
    """Slices, and cuts between them, change nothing; no product holds more than a slice."""
    rows = [(f"c{i:03}", f"d{i % 3}", [float(i % 17), float(i % 5)]) for i in range(200)]
    chunks = frame("chunk_id string, document_id string, embedding array<float>", rows)
    asked = frame("question_id int, embedding array<float>, k int", [(i, [float(i), 1.0], 1 + i % 4) for i in range(9)])
    order = lambda hits: sorted((r.question_id, r["rank"], r.chunk_id, r.score) for r in hits.collect())
    want = order(vector.nearest(asked, chunks))
    monkeypatch.setattr(vector, "_ROWS", 7)
    monkeypatch.setattr(vector, "_WAITING", 5)
    assert order(vector.nearest(asked, chunks, config=Config(resident_questions=2, block_questions=4, block_vectors=50))) == want

    class Wide(vector._Best):
        def offer(self, members, left, right, allowed, ids):
            assert len(right) <= 7 and all(len(column) == len(right) for column in ids)
            super().offer(members, left, right, allowed, ids)

    state = vector._Questions([(1, [0.0, 0.0], None, None, 3)], "l2")
    vector._scan(state, pa.table({"c": [r[0] for r in rows], "d": [r[1] for r in rows], "s": pa.nulls(200, pa.string()), "e": [r[2] for r in rows]}), Wide(state))


@pytest.mark.parametrize("vectors", [[1, 2, 3, None, None], [1, 1, 1, 2, 7, None, None]])
def test_texts_of_chunks_stay_where_they_lie(spark, frame, tmp_path, vectors):
    """The rows that the join with the vectors gives, which moves no text unless an id has several vectors."""
    from corpusframe.plans import model_tables

    docs = [(1, "a b", 3), (1, "c", 1), (2, None, None), (3, "d", 1), (4, "e", 1), (None, "f", 1)]
    frame("doc_id bigint, text string, n_chars int", docs).write.parquet(str(tmp_path / "documents.parquet"))
    frame("vec_id bigint, embedding array<float>, label int", [(v, [1.0], 0) for v in vectors]).write.parquet(str(tmp_path / "embeddings.parquet"))
    texts = model_tables.chunk_texts(spark, str(tmp_path))
    key = lambda df: sorted(map(repr, df.select(texts.columns).collect()))
    assert key(texts) == key(model_tables.chunks(spark, str(tmp_path)))
    assert ("Join" in texts._jdf.queryExecution().optimizedPlan().toString()) == (vectors.count(1) > 1)
