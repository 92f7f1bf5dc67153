import random
from datetime import datetime, timedelta

from corpusframe.config import Config
from corpusframe.operators import history, library, scale
from pyspark.sql import Window
from pyspark.sql import functions as F

START = datetime(2026, 1, 1)
RUN = "run_id string, chat_id string, created_at timestamp, question string, answer string, answered boolean, mode string, latency_ms double"


def run_rows(seed=1, n=400):
    """One chat holds a third of all runs."""
    rng = random.Random(seed)
    return [(f"r{i:04d}", "hot" if i % 3 == 0 else f"chat{rng.randint(0, 20)}", START + timedelta(minutes=rng.randint(0, 9000)),
             f"question {i}", f"answer {i}", rng.random() < .4, rng.choice(["naive", "agentic"]), float(i)) for i in range(n)]


def test_turns_equal_a_plain_window(frame):
    runs = frame(RUN, run_rows())
    plain = Window.partitionBy("chat_id").orderBy("created_at", "run_id")
    want = {r.run_id: r.n for r in runs.withColumn("n", F.row_number().over(plain) - 1).collect()}
    assert {r.run_id: r.turn_index for r in history.assign_turns(runs).collect()} == want


def test_previous_answered_equals_a_loop(frame, monkeypatch):
    monkeypatch.setattr(history, "HALO_BLOCK", 25)
    turned = history.assign_turns(frame(RUN, run_rows(2)))
    got = {r.run_id: r.reusable_run_id for r in history.previous_answered(turned).collect()}
    chats = {}
    for r in turned.orderBy("turn_index").collect():
        chats.setdefault(r.chat_id, []).append(r)
    want = {}
    for turns in chats.values():
        for i, turn in enumerate(turns):
            back = turns[max(0, i - 20):i][::-1]
            want[turn.run_id] = next((t.run_id for t in back if t.answered), back[0].run_id if back else None)
    assert got == want


def test_pick_reusable(frame):
    shape = "run_id string, chat_id string, turn_index long, answered boolean"
    got = history.pick_reusable(frame(shape, [
        ("a3", "a", 3, False), ("a2", "a", 2, True), ("a1", "a", 1, True), ("b3", "b", 3, False), ("b2", "b", 2, False)]
        + [(f"c{i}", "c", i, i == 0) for i in range(30)]))
    assert {r.chat_id: r.run_id for r in got.collect()} == {"a": "a2", "b": "b3", "c": "c29"}


def test_history_text(frame):
    shape = "run_id string, chat_id string, turn_index long, question string, answer string, filenames array<string>"
    rows = [(f"r{i}", "a", i, f"q{i}", None if i == 5 else "w " * 200, ["b", "a", "b"] if i == 4 else []) for i in range(6)]
    history_text = history.render_history(frame(shape, rows), 2).first().history
    clipped = "w " * 119 + "w"
    assert history_text == f"Q: q4\nA: {clipped + ' w' if len(clipped) < 239 else clipped}…\nDocuments used: a, b\n\nQ: q5\nA: (no answer)"


def test_pages_and_retention(frame):
    runs = frame(RUN, run_rows(3, 60))
    rows = sorted(run_rows(3, 60), key=lambda r: (-r[2].timestamp(), r[0]))
    page = history.list_runs(runs, "naive", None, 5, 2).collect()
    naive = [r[0] for r in rows if r[6] == "naive"]
    assert [r.run_id for r in page] == naive[2:7] and page[0].total == len(naive)
    assert {r.run_id for r in history.retain_runs(runs, 7).collect()} == {r[0] for r in rows[:7]}
    assert history.retain_runs(runs).count() == 60


def test_chats_and_cascades(frame):
    chats = frame("chat_id string, title string, updated_at timestamp", [("a", "A", START), ("b", "B", START + timedelta(days=1)), ("empty", "E", START)])
    runs = frame("run_id string, chat_id string", [("r1", "a"), ("r2", "a"), ("r3", "b")])
    listed = history.list_chats(chats, runs).collect()
    assert [(r.chat_id, r.turn_count, r.total) for r in listed] == [("b", 1, 2), ("a", 2, 2)]
    assert [r.chat_id for r in history.empty_chats(chats, runs).collect()] == ["empty"]
    left_chats, left_runs = history.delete_runs(chats, runs, frame("run_id string", [("r3",), ("r1",)]))
    assert {r.chat_id for r in left_chats.collect()} == {"a", "empty"} and {r.run_id for r in left_runs.collect()} == {"r2"}
    left_chats, left_runs = history.delete_chats(chats, runs, frame("chat_id string", [("a",)]))
    assert {r.chat_id for r in left_chats.collect()} == {"b", "empty"} and {r.run_id for r in left_runs.collect()} == {"r3"}
    named = history.chats_from_runs(frame(RUN, run_rows(4, 30)))
    assert named.where("chat_id = 'hot'").first().turn_count == 10
    assert history.chat_turns(chats, runs).count() == 3


def test_prompt_attribution(frame):
    versions = frame("prompt string, version int", [("answer_generation", 3), ("retrieval_planner", 1), ("evidence_validation", 2), ("other", 9)])
    runs = frame("run_id string, mode string", [("n", "naive"), ("a", "agentic"), ("x", "odd")])
    got = {}
    for r in history.prompt_attribution(runs, versions).collect():
        got.setdefault(r.run_id, set()).add((r.prompt, r.version))
    assert got["n"] == {("answer_generation", 3)} and len(got["a"]) == 3 and len(got["x"]) == 4


def test_library_views(frame):
    docs = frame("document_id string, filename string, status string, summary string, created_at timestamp, size_bytes long, chunk_count long", [
        ("1", "Leave.pdf", "READY", "All  about\nleave", START, 10, 2), ("2", "pay.md", "READY", None, START + timedelta(days=1), 30, 0),
        ("3", "old.txt", "FAILED", None, START, 5, 0), ("4", "new.docx", "PROCESSING", None, START, 7, 0)])
    assert {r.document_id for r in library.needing_attention(docs).collect()} == {"2", "3"}
    whole = library.catalogue(docs).first()
    assert whole.content == "The document library contains 2 document(s).\n- pay.md\n- Leave.pdf — All about leave" and not whole.truncated
    short = library.catalogue(docs, config=Config(catalogue_limit=1)).first()
    assert short.content == "The document library contains 2 document(s). Showing the 1 most recent:\n- pay.md" and short.truncated
    assert library.catalogue(docs, ["3"]).count() == 0
    assert [r.document_id for r in library.list_library(docs, " LEA").collect()] == ["1"]
    assert [r.document_id for r in library.list_library(docs, sort="size", ascending=False).collect()] == ["2", "1", "4", "3"]
    totals = library.library_totals(library.list_library(docs, status="READY")).first()
    assert (totals.documents, totals.bytes, totals.chunks, totals.kinds) == (2, 40, 2, "Markdown, PDF")
    files = frame("storage_path string", [("p1",), ("p4",)])
    stored = docs.withColumn("storage_path", F.concat(F.lit("p"), "document_id"))
    assert [r.document_id for r in library.reprocess_candidates(stored, files).collect()] == ["1"]


STATUS = "document_id string, at timestamp, event_id int, status string, failure_kind string"
EVENTS = [("a", 0, "UPLOADED", None), ("a", 1, "PROCESSING", None), ("a", 2, "FAILED", "provider"), ("a", 3, "PROCESSING", None), ("a", 4, "READY", None),
          ("b", 1, "PROCESSING", None), ("b", 2, "FAILED", "parse"), ("c", 0, "UPLOADED", None)]


def status_rows():
    return [(d, START + timedelta(minutes=m), i, s, k) for i, (d, m, s, k) in enumerate(EVENTS)]


def test_status_fold(frame):
    got = {r.document_id: (r.status, r.attempts, r.failure_kind) for r in library.fold_status(frame(STATUS, status_rows())).collect()}
    assert got == {"a": ("READY", 2, None), "b": ("FAILED", 1, "parse"), "c": ("UPLOADED", 0, None)}


def test_top_k_in_two_steps(frame, monkeypatch):
    df = frame("k int, v int", [(i % 3 if i % 2 else 0, i) for i in range(500)]).repartition(7)
    want = sorted(map(tuple, scale.top_k(df, ["k"], [F.desc("v")], 4).collect()))
    monkeypatch.setattr(scale, "WIDE_PARTITIONS", 0)
    monkeypatch.setattr(scale, "MERGE_WIDTH", 3)
    plan = scale.top_k(df, ["k"], [F.desc("v")], 4)
    assert sorted(map(tuple, plan.collect())) == want
    bounded = scale.top_k(df.withColumn("n", F.col("k") + 1), ["k"], [F.desc("v")], F.col("n"))
    assert sorted(r.k for r in bounded.collect()) == [0, 1, 1, 2, 2, 2]


def test_numbering_and_halo_helpers(frame):
    rows = [(i % 2, i) for i in range(100)]
    df = frame("k int, v int", rows)
    got = scale.numbered(df, ["k"], ["v"], "n")
    assert all(r.n == r.v // 2 + 1 for r in got.collect())
    halo = scale.with_halo(frame("n int", [(i,) for i in range(10)]), "n", 2, 5)
    assert sorted((r._block, r.n, r._halo) for r in halo.collect()) == sorted(
        [(i // 5, i, False) for i in range(10)] + [(1, 3, True), (1, 4, True), (2, 8, True), (2, 9, True)])


def test_status_tells_why_and_notes_a_missing_summary(frame):
    rows = [("a", START, 1, "PROCESSING", None, None, None), ("a", START, 2, "FAILED", "provider", "quota is used up", None),
            ("b", START, 1, "FAILED", "parse", "bad file", None), ("b", START, 2, "PROCESSING", None, None, None),
            ("c", START, 1, "READY", None, None, None), ("d", START, 1, "READY", None, None, "about d")]
    df = frame(STATUS + ", error_message string, summary string", rows)
    got = {r.document_id: (r.status, r.failure_kind, r.error_message) for r in library.fold_status(df).collect()}
    assert got == {"a": ("FAILED", "provider", "quota is used up"), "b": ("PROCESSING", None, None),
                   "c": ("READY", None, library.MISSING_SUMMARY), "d": ("READY", None, None)}


def test_one_key_with_one_stamp_lies_in_many_ranges(spark):
    """A bulk import: all rows have one key and one time, and only their ids tell them apart."""
    df = spark.range(20_000).select(F.lit("chat").alias("k"), F.lit(START).alias("at"), F.col("id"))
    ranged = scale.in_ranges(df, [F.col("k"), F.col("at"), F.col("id")])
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3 * 20_000 / len(sizes)
    got = scale.numbered(df, ["k"], ["at", "id"], "n")
    assert got.where("n <> id + 1").count() == 0
    carried = scale.carried_forward(df, ["k"], ["at", "id"], F.when(F.col("id") % 7000 == 5, F.col("id")), "last")
    assert carried.where("not (last <=> if(id < 5, null, int((id - 5) / 7000) * 7000 + 5))").count() == 0


def test_a_null_key_is_a_key(frame):
    df = frame("k string, v int", [(None, 3), ("a", 1), (None, 1), ("a", 2), (None, 2)])
    assert sorted((str(r.k), r.v, r.n) for r in scale.numbered(df, ["k"], ["v"], "n").collect()) == [
        ("None", 1, 1), ("None", 2, 2), ("None", 3, 3), ("a", 1, 1), ("a", 2, 2)]


def test_stored_results(spark, frame, tmp_path):
    from corpusframe.schemas import RUNS
    from corpusframe.sources import tables

    runs = frame("run_id string, chat_id string, turn_index bigint, answered boolean, created_at timestamp", [
        (f"r{i}", "c", i, i != 1, datetime(2026, 1, 1 + i)) for i in range(4)])
    hits = frame("run_id string, number int, chunk_id string, document_id string, content string, other int", [
        ("r0", 2, "b", "d", "two", 1), ("r0", 1, "a", "d", "one", 1), ("r1", 1, "z", "d", None, 1), ("r2", 1, None, "d", "x", 1)])
    cited = frame("run_id string, number int", [("r0", 2), ("r0", 2), ("r9", 1)])
    path = str(tmp_path / "runs")
    tables.append_runs(history.with_results(runs, hits, cited), path)
    stored = tables.read_runs(spark, path)
    assert {r.run_id: (len(r.results), r.cited) for r in stored.collect()} == {"r0": (2, [2]), "r1": (1, []), "r2": (1, []), "r3": (0, [])}
    got = history.carried_chunks(stored)
    # Turn 1 found nothing it could answer with, so turn 2 goes back to turn 0; turn 3 reuses turn 2.
    assert sorted((r.run_id, r.reused_run_id, r.number, r.chunk_id, r.was_cited) for r in got.where("chunk_id is not null").collect()) == [
        ("r1", "r0", 1, "a", False), ("r1", "r0", 2, "b", True), ("r2", "r0", 1, "a", False), ("r2", "r0", 2, "b", True)]
    assert [(r.run_id, r.reused_run_id, r.chunk_id) for r in got.where("chunk_id is null").collect()] == [("r3", "r2", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "results:array" in line]
    assert reads and all("results:array<struct<number:int,chunk_id:string,document_id:string>>" in line.replace(" ", "") for line in reads), reads
    one = history.stored_results(stored, ["content"], frame("run_id string", [("r0",), ("r0",)]))
    assert sorted((r.number, r.content, r.was_cited) for r in one.collect()) == [(1, "one", False), (2, "two", True)]
    late = tables.read_runs(spark, path, since="2026-01-03", schema=RUNS)
    assert sorted(r.run_id for r in late.collect()) == ["r2", "r3"] and "answer" in late.columns
    assert history.carried_chunks(stored.limit(0)).count() == 0
