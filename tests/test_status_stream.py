import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from corpusframe.operators import library, reuse
from corpusframe.streaming import answers, status
from test_history import START

SHAPE = "document_id string, at timestamp, event_id bigint, status string, failure_kind string, error_message string, summary string"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def events(n=60):
    rng = random.Random(4)
    kinds = [("PROCESSING", None, None, None), ("FAILED", "provider", "quota", None), ("READY", None, None, None), ("READY", None, None, "about")]
    return [(f"d{rng.randrange(7)}", START + timedelta(minutes=rng.randrange(300)), i, *rng.choice(kinds)) for i in range(n)]


def run(spark, frame, batches, path, name, **options):
    """Every batch is one file and one trigger; the last row of each document stands."""
    out, last = {}, []
    for i, batch in enumerate(batches):
        frame(SHAPE, batch).coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))

    def keep(df, number):
        for r in df.collect():
            out[r.document_id] = tuple(r)
            last.append(tuple(r))

    query = status.stream_status(stream, **options).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, last


def test_update_mode_equals_the_batch_fold(rocks, frame, tmp_path):
    rows = events()
    shuffled = random.Random(1).sample(rows, len(rows))
    # Out of order, and some of them twice.
    out, _ = run(rocks, frame, [shuffled[:30], shuffled[20:50], shuffled[40:]], tmp_path, "state")
    want = {r.document_id: tuple(r) for r in library.fold_status(frame(SHAPE, rows)).select(*[c.split()[0] for c in status.STATUS.split(", ")]).collect()}
    assert out == want


def test_an_attempt_that_never_ends(rocks, frame, tmp_path):
    one = [("a", START, 1, "PROCESSING", None, None, None), ("b", START, 2, "PROCESSING", None, None, None)]
    two = [("b", START + timedelta(minutes=5), 3, "READY", None, None, "about b")]
    three = [("c", START + timedelta(hours=9), 4, "READY", None, None, "x")]
    out, _ = run(rocks, frame, [one, two, three, [("c", START + timedelta(hours=10), 5, "READY", None, None, "x")]], tmp_path, "state",
                 patience=timedelta(hours=1), late="1 minute")
    assert out["a"][1:3] == ("FAILED", 1) and out["a"][4:] == status.STUCK
    assert out["b"][1] == "READY" and out["b"][4:] == (None, None)


def test_newest_answers_equal_the_batch_form(rocks, frame, tmp_path):
    rng = random.Random(9)
    minutes = lambda n: START + timedelta(minutes=n)
    stored = [(f"e{rng.randrange(4)}", minutes(i * 3 + rng.randrange(2)), rng.choice([60, 600, 7200]), f"q{i}") for i in range(50)]
    asked = [(f"{i}", f"e{rng.randrange(5)}", minutes(rng.randrange(180)) + timedelta(seconds=30)) for i in range(80)]
    shapes = {"a": "entry string, stored_at timestamp, ttl_seconds bigint, question string", "q": "question_id string, entry string, asked_at timestamp"}
    # Each batch holds an hour of both streams, out of order inside it; the last one only moves the watermark.
    for hour in range(4):
        within = lambda at: minutes(60 * hour) <= at < minutes(60 * hour + 60)
        for name, rows, at in (("a", stored, 1), ("q", asked, 2)):
            some = [r for r in rows if within(r[at])] + ([("end", "e0", minutes(10_000))] if name == "q" and hour == 3 else [])
            rng.shuffle(some)
            frame(shapes[name], some).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = {n: rocks.readStream.schema(shapes[n]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in shapes}
    got = []
    query = answers.stream_newest(streams["q"], streams["a"], "1 hour").writeStream.outputMode("append").foreachBatch(
        lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = reuse.reuse_exact(frame(shapes["q"], asked), frame(shapes["a"], stored)).collect()
    assert sorted(got) == sorted((r.question_id, r.entry, r.stored_at, r.cached_question) for r in want) != []
