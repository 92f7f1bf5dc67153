import math
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import blocks, common
from corpusframe.llm import op5_pst as pst
from corpusframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
END = b""


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def by_hand(rows):
    """The same tree from plain dictionaries."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(t for (_, text), out in zip(rows, held) if not out for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    grams = defaultdict(Counter)
    for (_, text), out in zip(rows, held):
        words = tokens(text)
        for i in range(len(words)):
            for d in range(1, pst.DEPTH + 1):
                if not out and i >= d:
                    grams[tuple(words[i - d : i])][words[i]] += 1
    base = lambda t: (counts[t] + 1) / (total + kinds + 1)
    retained = {}

    def chance(context, t):
        while context and not retained.get(context):
            context = context[1:]
        if not context:
            return base(t)
        own = grams[context]
        return (own[t] + len(own) * chance(context[1:], t)) / (sum(own.values()) + len(own))

    for d in range(1, pst.DEPTH + 1):
        for context in [c for c in grams if len(c) == d]:
            own = grams[context]
            # Its beginnings have to be candidates as well.
            if any((grams[context[:e]][context[e]] if e else counts[context[0]]) < pst.LEAST_SEEN for e in range(d)):
                continue
            n, k = sum(own.values()), len(own)
            gain = sum(c * math.log((c + k * chance(context[1:], t)) / (n + k) / chance(context[1:], t)) for t, c in own.items())
            retained[context] = gain > pst.LEAST_GAIN * k
    out = []
    for (doc_id, text), o in zip(rows, held):
        words = tokens(text)
        score = sum(math.log10(chance(tuple(words[max(0, i - pst.DEPTH) : i]), t)) for i, t in enumerate(words))
        out.append((doc_id, o, len(words), sum(counts[t] > 0 for t in words), total, sum(math.log10(base(t)) for t in words), score))
    return out, retained


def agree(got, want):
    order = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_query_equals_dictionaries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want, retained = by_hand(rows)
    got = QUERIES["op5_pst"](spark, FOLDER).collect()
    agree(got, want)
    assert {len(c) for c, kept in retained.items() if kept} and not all(retained.values())
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_strange_rows(spark):
    rows = [(i, f"one two three {'four' if i % 2 else 'five six'} one two {i % 5}") for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "ONE two"), (5, rows[5][1]), (5, rows[5][1]), (203, "long one two " * 50_000), (204, "Ä ä ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("gid", F.lit(1)).withColumn("score", F.lit(1))
    agree(pst.score(df).collect(), by_hand(rows)[0])
    assert pst.score(df.limit(0)).count() == 0
    untaught = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (only,) = pst.score(spark.createDataFrame([(untaught, "a b")], "doc_id long, text string")).collect()
    assert only.n_known == 0 and only.train_tokens == 0 and only.score == only.base_score == 0


def test_packs_stay_in_their_buckets(spark):
    rows = [(i, f"one two three {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packs = common.in_buckets(df.mapInArrow(pst._packs, "gid long, body binary"), 8)
    answers = spark.createDataFrame([(r.gid, 0, 0, b"") for r in packs.collect()], f"gid long, {pst._ANSWER[7:-1]}")
    assert common.bucket_count(packs) == 8
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = packs.join(blocks.gathered(answers, packs), "gid", "left")
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert met.where("answers is not null").count() == 3
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_once_a_table_is_stored(spark):
    before, setting = shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(setting, None)
    table = common.stored(spark.range(1000).repartition(5, "id"))
    packs = common.in_buckets(spark.range(1000).selectExpr("id AS gid", "'x' AS body"), 8)
    for _ in range(100):
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert table.count() == packs.count() == 1000 and spark.conf.get(setting, None) == given
    assert not left


def test_a_pack_needs_little_memory():
    """A walk takes 54 bytes per token at once here; with numbers of 64 bits for every place it took 107."""
    texts = [b" ".join(b"w%d" % (w * w % 997) for w in range(i, i + 400)) for i in range(500)]
    blob, answers, peaks = pst._tokens_blob(list(range(len(texts))), texts), {}, []
    while True:
        read = pst.Tokens(blob)
        tracemalloc.start()
        walk = pst.Walk(read, answers, 1e-6)
        peaks.append(tracemalloc.get_traced_memory()[1] / len(read.tokens))
        tracemalloc.stop()
        if not walk.asks:
            break
        # As if this pack were the only one.
        for topic, (keys, values) in walk.asks.items():
            answers[topic] = 2 * values + (values > 0) if topic % 3 == pst.SEEN else values
        walk = keys = values = None
    assert len(peaks) == pst.DEPTH + 4
    assert max(peaks) < 75


def test_packs_wait_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    given, bits = spark.conf.get(setting, None), 4

    def ask(batches):
        for batch in batches:
            gid = batch.column("gid")[0].as_py()
            yield from blocks.blocks(gid, 0, np.array([gid], np.uint64), np.array([float(batch.nbytes)]), bits)

    rows = spark.range(30).repartition(1).selectExpr("id AS gid", "repeat('x', 1000000) AS body")
    answers = blocks.answered(rows.mapInArrow(ask, blocks.ASKS), bits, np.float64, lambda topic, which, values, pack: values).collect()
    sizes = [blocks.expand(r.answer, np.float64)[0] for r in answers]
    assert sum(sizes) > 30e6 and max(sizes) < common.BATCH_BYTES + 2e6
    assert spark.conf.get(setting, None) == given


def test_gains_are_answered_by_yes_or_no():
    """A hundred thousand sums filled hundreds of kB; the answers take a bit or two each."""
    rng = np.random.default_rng(5)
    which, values = np.tile(np.arange(100_000, dtype=np.int32), 2), rng.normal(size=200_000)
    got = pst._combine(3 + pst.GAINS, which, values, np.repeat(np.arange(2, dtype=np.int32), 100_000))
    assert (got == np.tile(values[:100_000] + values[100_000:] > 0, 2)).all()
    assert len(blocks.squeeze(got[:100_000])) < 50_000
