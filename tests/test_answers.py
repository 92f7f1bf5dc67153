from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusframe.config import Config
from corpusframe.operators import conflicts
from corpusframe.operators import context as packing

OLD, NEW = datetime(2026, 1, 10), datetime(2026, 8, 18)
CHUNK = "question_id int, number int, chunk_id string, document_id string, filename string, content string, uploaded_at timestamp, url string"


def found(frame, rows):
    return conflicts.find_conflicts(conflicts.extract_claims(frame(CHUNK, rows), ["question_id"]), ["question_id"])


def row(n, doc, content, at=None, url=None, question=1):
    return (question, n, f"c{n}", doc, f"{doc}.md", content, at, url)


def test_claims(frame):
    got = conflicts.extract_claims(frame(CHUNK, [row(1, "d", "Employees accrue 22 days of paid annual leave. Room 7.\nPay 1.5 times the hourly rate")])).collect()
    assert [(r.value, r.key) for r in got] == [("22", ["day", "paid", "annual", "leave"]), ("1.5", ["time", "hourly", "rate"])]


def test_newest_document_wins(frame):
    got = found(frame, [row(1, "old", "22 days of paid annual leave", OLD), row(2, "new", "25 days paid annual leave", NEW)])
    assert {(r.document_id, r.value, r.current) for r in got.collect()} == {("old", "22", False), ("new", "25", True)}
    note = conflicts.conflict_notes(got, ["question_id"]).first()
    assert note.subject == "day paid annual leave"
    assert note.note == ("day paid annual leave: new.md says 25 (uploaded 2026-08-18) — most recent. "
                         "Previously old.md says 22 (uploaded 2026-01-10).")


def test_undated_never_wins_and_ties_keep_order(frame):
    got = found(frame, [row(1, "x", "22 days of paid leave"), row(2, "y", "25 days of paid leave", OLD), row(3, "z", "26 days of paid leave", OLD)])
    assert {r.document_id for r in got.where("current").collect()} == {"y"}
    assert "y.md says 25" in conflicts.conflict_notes(got, ["question_id"]).first().note.split("most recent")[0]
    none = found(frame, [row(1, "x", "22 days of paid leave"), row(2, "y", "25 days of paid leave")])
    assert [r.document_id for r in none.where("current").collect()] == ["x"]


def test_what_is_not_a_conflict(frame):
    cases = [
        [row(1, "a", "22 days of annual leave"), row(2, "b", "22 days of annual leave")],
        [row(1, "a", "22 days of annual leave or so"), row(2, "a", "25 days of annual leave or so")],
        [row(1, "a", "22 days of annual leave"), row(2, "b", "12 days of sick leave")],
        [row(1, "a", "22 days of annual leave"), row(2, "calculation", "25 days of annual leave")],
        [row(1, "a", "22 days of annual leave"), row(2, "w", "25 days of annual leave", None, "http://x")],
        # Across questions nothing is compared, and a document speaks through its first claim only.
        [row(1, "a", "22 days of annual leave"), row(2, "b", "25 days of annual leave", question=2)],
        [row(1, "a", "22 days of annual leave"), row(2, "b", "22 days of annual leave"), row(3, "b", "25 days of annual leave")],
    ]
    for rows in cases:
        assert found(frame, rows).count() == 0


def test_upload_times_come_from_documents(frame):
    docs = frame("document_id string, created_at timestamp", [("a", OLD)])
    got = conflicts.stamp_upload_times(frame(CHUNK, [row(1, "a", "x", NEW), row(2, "b", "y", NEW)]), docs).orderBy("number").collect()
    assert [r.uploaded_at for r in got] == [OLD, None]


HIT = "question_id int, number int, chunk_id string, document_id string, filename string, content string"


def test_context_budget(frame):
    hits = frame(HIT, [(1, i, f"c{i}", "d", "f.md", "x" * 400) for i in range(1, 21)] + [(2, 1, "big", "d", "f.md", "y" * 40000), (2, 2, "more", "d", "f.md", "z")])
    config = Config(context_tokens=2048)
    kept = packing.fit_to_context(hits, config)
    numbers = [r.number for r in kept.where("question_id = 1").orderBy("number").collect()]
    assert numbers == list(range(1, len(numbers) + 1)) and 0 < len(numbers) < 20
    rendered = packing.render_context(kept.where("question_id = 1")).first().context
    assert len(rendered) <= (2048 - 1200) * 3.5 == packing.allowance(config)
    more = packing.render_context(hits.where(f"question_id = 1 and number <= {len(numbers) + 1}")).first().context
    assert len(more) > packing.allowance(config)
    assert [r.chunk_id for r in kept.where("question_id = 2").collect()] == ["big"]
    assert packing.allowance(Config(context_tokens=1300)) == int(512 * 3.5)


def test_rendered_headers(frame):
    hits = frame(HIT + ", uploaded_at timestamp, section_path string, page_number int, url string", [
        (1, 1, "a", "d", "f.md", "body", OLD, "A > B", 3, None), (1, 2, "w", "web", "acme.com", "page", None, None, None, "http://acme.com"),
        (1, 3, "k", "calculation", "calc", "22 - 8 = 14", None, None, None, None)])
    assert packing.render_context(hits).first().context == (
        "[1] f.md | uploaded 2026-01-10 | section: A > B | page 3\nbody\n\n---\n\n[2] WEB: acme.com | http://acme.com\npage"
        "\n\n---\n\n[3] CALCULATION\n22 - 8 = 14")


def test_merge_context(frame):
    shape = "question_id int, number int, chunk_id string"
    fresh = frame(shape, [(1, 1, "a"), (1, 2, "b")])
    carried = frame(shape, [(1, 1, "a"), (1, 2, "p"), (1, 3, "q"), (1, 4, "r")])
    order = lambda df: [(r.number, r.chunk_id) for r in df.orderBy("number").collect()]
    assert order(packing.merge_context(fresh, carried, 3)) == [(1, "a"), (2, "b"), (3, "p"), (4, "q")]
    assert order(packing.merge_context(fresh, carried, 3, cap_first=False)) == [(1, "a"), (2, "b"), (3, "p"), (4, "q"), (5, "r")]
    assert order(packing.merge_context(fresh.where("false"), carried)) == [(1, "a"), (2, "p"), (3, "q"), (4, "r")]


def test_citations_resolve_and_credit(frame):
    answers = frame("question_id int, answer string", [(1, "Fourteen days remain [3]. See [9] and [3, 1].")])
    hits = frame(HIT + ", derived_from array<string>", [
        (1, 1, "c1", "d", "f", "x", []), (1, 2, "c2", "d", "f", "22 days", []), (1, 3, "k", "calculation", "f", "22 - 8", ["c2", "c1", "gone"])])
    resolved = packing.resolve_citations(answers, hits)
    assert [(r.number, r.hallucinated) for r in resolved.orderBy("position").collect()] == [(3, False), (9, True), (1, False)]
    credited = packing.credit_derived(resolved, hits).orderBy("citation_no").collect()
    assert [(r.chunk_id, r.credited) for r in credited] == [("k", False), ("c1", False), ("c2", True)]
    assert [r.chunk_id for r in packing.unused_hits(hits, resolved).collect()] == ["c2"]


def test_contributing_chunks(frame):
    hits = frame("question_id int, chunk_id string, document_id string, content string", [
        (q, c, d, t) for q in range(1, 6) for c, d, t in [
            ("c1", "d", "Employees accrue 22 days."), ("c2", "d", "Form 1220 applies"), ("c3", "d", "rate x 1.75 or 22"),
            ("c4", "calculation", "22 - 8"), ("c5", "d", "Overtime is 1.5 x for 20 hours over 6 days")]])
    sums = frame("question_id int, expression string, question string", [
        (1, "22 - 8", "I have taken 8 days"), (2, "1 + 2", ""), (3, "20 * 1.5 * 6", "My rate is 20 and I worked 6"),
        (4, "12 + 30", "What is 12 + 30?"), (5, "1.75 * 2", None)])
    got = {}
    for r in packing.contributing_chunks(sums, hits).collect():
        got.setdefault(r.question_id, set()).add(r.chunk_id)
    assert got == {1: {"c1", "c3"}, 3: {"c5"}, 5: {"c3"}}


def test_answer_status(frame):
    answers = frame("question_id int, answer string", [
        (1, "Employees get 22 days of leave [1]."), (2, "NOT_FOUND"), (3, "[2]"), (4, "A long answer without any marker."), (5, "Anything [1] at all here really")])
    hits = frame("question_id int, chunk_id string", [(i, "c") for i in (1, 2, 3, 4)])
    got = {r.question_id: (r.status, r.answered, r.needs_retry) for r in packing.answer_status(answers, hits).collect()}
    assert got == {1: ("answered", True, False), 2: ("not_found", False, False), 3: ("degenerate", False, True),
                   4: ("uncited", True, True), 5: ("no_results", False, False)}


def test_final_context(frame):
    hits = frame("question_id int, chunk_id string, document_id string, score double, rank int, fused_score double, sources array<string>", [
        (1, "a", "d1", .1, 1, .02, ["semantic"]), (1, "b", "d1", .2, 2, .03, ["semantic"]), (1, "c", "d2", .3, 3, .01, ["keyword"])])
    carried = frame("question_id int, chunk_id string, document_id string, score double, number int", [(1, "b", "d1", .1, 1), (1, "z", "d9", .1, 2)])
    order = lambda df: [r.chunk_id for r in df.orderBy("number").collect()]
    assert order(packing.final_context(hits, carried, 2)) == ["b", "a", "z"]
    assert order(packing.final_context(hits, carried, 2, aggregated=True)) == ["a", "c", "b", "z"]


def test_note_above_the_sources(frame):
    rows = [row(2, "old", "20 parking spaces kept for guests", OLD), row(10, "new", "30 parking spaces kept for guests. 9 meeting rooms upstairs", NEW),
            row(9, "old", "8 meeting rooms upstairs", OLD), row(1, "a", "5 of everything here", OLD, question=2)]
    got = conflicts.context_notes(found(frame, rows), ["question_id"]).collect()
    assert [(r.question_id, r.conflicts) for r in got] == [(1, 2)]
    lines = got[0].note.split("\n")
    assert lines[0] == "NOTE — the sources disagree with each other." and lines[6] == ""
    # Source 2 comes before source 9, whatever their names.
    assert [line.split(":")[0] for line in lines[7:]] == ["- parking space kept guest", "- meeting room upstair"]
    assert conflicts.context_notes(found(frame, rows[:1]), ["question_id"]).count() == 0
    with pytest.raises(ValueError):
        conflicts.context_notes(found(frame, rows), [])
