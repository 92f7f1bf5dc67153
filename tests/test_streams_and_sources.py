from datetime import timedelta

from pyspark.sql import functions as F

from corpusframe.operators import library
from corpusframe.sources import tables
from corpusframe.streaming import jobs
from test_history import RUN, START, STATUS, run_rows, status_rows


def write_files(folder, files):
    folder.mkdir(exist_ok=True)
    for name, body in files.items():
        (folder / name).write_bytes(body if isinstance(body, bytes) else body.encode())


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_files_are_described(spark, tmp_path):
    write_files(tmp_path / "in", {"a.txt": "Leave Rules\n22 days.", "b.pdf": b"%PDF-1.4 x", "c.bin": b"\x00"})
    rows = {r.filename: r for r in tables.read_files(spark, str(tmp_path / "in")).collect()}
    assert rows["a.txt"].mime == "text/plain" and rows["a.txt"].content.startswith("Leave") and rows["a.txt"].size == 20
    assert rows["b.pdf"].content is None and bytes(rows["b.pdf"].head).startswith(b"%PDF")
    assert rows["c.bin"].mime == "application/octet-stream"


def test_ingest_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "chunks")
    write_files(source, {"a.txt": "Leave Rules\nWe give 22 days.\n\nMore text here.", "copy.txt": "Leave Rules\nWe give 22 days.\n\nMore text here.",
                         "b.md": "intro words\n# PAY SCALE\nten.", "c.pdf": b"not a pdf"})
    batch = jobs.ingest_batch(tables.read_files(spark, str(source)))
    columns = ["chunk_id", "content", "section_path", "page_number", "start"]
    want = sorted(map(tuple, batch.select(*columns).collect()))
    assert len(want) == 3 and {w[2] for w in want} == {"Leave Rules", "Preamble", "PAY SCALE"}
    for checkpoint in ("one", "two"):  # a second full pass replaces the same chunks
        query = jobs.stream_ingest(spark, str(source), target, str(tmp_path / checkpoint))
        query.awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(target).select(*columns).collect()))
        assert got == want


def test_files_older_than_the_last_run_are_ingested_and_every_file_has_an_outcome(spark, tmp_path):
    import os

    source, target = tmp_path / "in", str(tmp_path / "chunks")
    for number, (name, body, age) in enumerate([("a.txt", "Alpha text.", 0), ("old.txt", "Older text.", 4 * 3600), ("c.txt", "Alpha  text.", 0)]):
        write_files(source, {name: body} | ({"x.pdf": b"not a pdf", "y.pdf": b"%PDF-1.7", "z.txt": " "} if number == 0 else {}))
        at = os.stat(source / name).st_mtime - age
        os.utime(source / name, (at, at))
        jobs.stream_ingest(spark, str(source), target, str(tmp_path / "state")).awaitTermination()
    # What repeats an earlier batch leaves the stored document as it is.
    assert {r.content for r in spark.read.parquet(target).collect()} == {"Alpha text.", "Older text."}
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.reason and r.reason.rsplit("/", 1)[-1]) for r in spark.read.option("recursiveFileLookup", "true").parquet(target + "_outcomes").collect()}
    assert got == {"a.txt": ("accepted", None), "old.txt": ("accepted", None), "c.txt": ("duplicate", "a.txt"),
                   "x.pdf": ("rejected", "type_mismatch"), "y.pdf": ("failed", "no_text"), "z.txt": ("failed", "no_text")}


def test_chunk_table_replaces_only_its_documents(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    shape = "document_id string, chunk_id string, content string"
    tables.write_chunks(frame(shape, [("a", "a:0", "x"), ("a", "a:1", "y"), ("b", "b:0", "z")]), path, buckets=2)
    tables.write_chunks(frame(shape, [("a", "a:0", "new")]), path, buckets=2)
    assert sorted((r.chunk_id, r.content) for r in spark.read.parquet(path).collect()) == [("a:0", "new"), ("b:0", "z")]


def test_runs_append_by_day(spark, frame, tmp_path):
    path = str(tmp_path / "runs")
    rows = run_rows(5, 20)
    tables.append_runs(frame(RUN, rows[:12]), path)
    tables.append_runs(frame(RUN, rows[12:]), path)
    assert spark.read.parquet(path).count() == 20


def test_a_day_of_runs_is_not_a_file_of_every_task(frame, tmp_path):
    rows = frame("run_id int, created_at timestamp", [(i, START + timedelta(days=i % 30)) for i in range(600)]).repartition(8)
    tables.append_runs(rows, str(tmp_path / "runs"))
    assert len(list((tmp_path / "runs").glob("day=*/*.parquet"))) == len(list((tmp_path / "runs").glob("day=*"))) >= 30


def stream_of(spark, frame, schema, rows, path):
    frame(schema, rows).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def test_status_stream_equals_batch(spark, frame, tmp_path):
    stream = stream_of(spark, frame, STATUS, status_rows(), tmp_path / "s")
    query = jobs.stream_latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("status_now").start()
    drain(query)
    key = lambda df: sorted(map(tuple, df.select("document_id", "status", "attempts", "last_attempt_at").collect()))
    assert key(spark.table("status_now")) == key(library.fold_status(frame(STATUS, status_rows())))


def test_reuse_stream_honours_the_lifetime(spark, frame, tmp_path):
    hour = timedelta(hours=1)
    questions = stream_of(spark, frame, "question_id int, entry string, asked_at timestamp", [
        (1, "e", START + hour), (2, "e", START - hour), (3, "e", START + 25 * hour), (4, "f", START)], tmp_path / "q")
    answers = stream_of(spark, frame, "entry string, stored_at timestamp", [("e", START)], tmp_path / "a")
    query = jobs.stream_reuse(questions, answers).select("question_id").writeStream.format("memory").queryName("reused").start()
    drain(query)
    assert [r.question_id for r in spark.table("reused").collect()] == [1]


def test_metrics_stream_equals_batch(spark, frame, tmp_path):
    from corpusframe.operators import history

    rows = run_rows(6, 100)
    stream = stream_of(spark, frame, RUN, rows, tmp_path / "r")
    query = jobs.stream_run_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("metrics").start()
    drain(query)
    key = lambda df: sorted((str(r.window.start), r.mode, r.runs, round(r.latency_avg, 6)) for r in df.collect())
    assert key(spark.table("metrics")) == key(history.run_metrics(frame(RUN, rows)))
    sessions = jobs.stream_chat_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    drain(sessions)
    assert spark.table("sessions").agg(F.sum("runs")).first()[0] == 100


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A driver started elsewhere still runs Python tasks."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    script = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from corpusframe.operators import vector\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "rows = spark.createDataFrame([('a', 'd', [1.0])], 'chunk_id string, document_id string, embedding array<double>')\n"
        "asked = spark.createDataFrame([(1, [1.0])], 'question_id int, embedding array<double>')\n"
        "print('found', vector.nearest(asked, rows).count())\n"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "found 1" in done.stdout, done.stderr[-2000:]
