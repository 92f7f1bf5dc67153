"""The newest stored answer for every question of a stream, with the answers of each entry kept between batches."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusframe.session import ship

REUSED = "question_id string, entry string, stored_at timestamp, cached_question string"


class _Newest(StatefulProcessor):
    """Answers and waiting questions of one entry.

    A question waits until the watermark has passed its moment, so all answers stored by then are known. It gets the
    newest of them if that one is still alive; storing again overwrites, even where the older answer would live longer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "stored_at bigint", "ends bigint, question string")
        self.waiting = handle.getMapState("waiting", "asked_at bigint, question_id string", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            stamps = part["at"].to_numpy("datetime64[us]").astype("int64")
            for at, question_id, ttl, question in zip(stamps.tolist(), part["question_id"], part["ttl_seconds"], part["question"]):
                if question_id is not None:
                    self.waiting.updateValue((at, question_id), (True,))
                    self.handle.registerTimer(at // 1000 + 1)
                else:
                    ends = at + int(ttl) * 1_000_000
                    self.answers.updateValue((at,), (ends, question))
                    self.handle.registerTimer(ends // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        stored = sorted((at[0], *value) for at, value in self.answers.iterator())
        found = []
        for asked_at, question_id in [tuple(k) for k in self.waiting.keys()]:
            if asked_at >= now:
                continue
            self.waiting.removeKey((asked_at, question_id))
            newest = max((row for row in stored if row[0] <= asked_at), default=None)
            if newest and asked_at < newest[1]:
                found.append((question_id, newest[0], newest[2]))
        # Of what is stored by now, only the newest answer counts for later questions, and only while it lives.
        past = [row for row in stored if row[0] <= now]
        for row in past[:-1] + [row for row in past[-1:] if row[1] <= now]:
            self.answers.removeKey((row[0],))
        if found:
            yield pd.DataFrame({
                "question_id": [f[0] for f in found], "entry": [key[0]] * len(found),
                "stored_at": pd.to_datetime([f[1] for f in found], unit="us"), "cached_question": [f[2] for f in found]})

    def close(self) -> None:
        pass


def stream_newest(questions: DataFrame, answers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row per question that an answer is reused for: what ``reuse.reuse_exact`` gives for the same rows.

    questions(question_id, entry, asked_at), answers(entry, stored_at, ttl_seconds, question). A question is answered
    once the watermark (``late`` behind the newest moment of either stream) has passed it; entries that are null are
    left out. State is dropped as answers are replaced or expire. Needs the RocksDB state store.
    """
    ship(questions.sparkSession)
    asked = questions.select(
        "entry", F.col("asked_at").alias("at"), F.col("question_id").cast("string").alias("question_id"),
        F.lit(None).cast("bigint").alias("ttl_seconds"), F.lit(None).cast("string").alias("question"))
    stored = answers.select(
        "entry", F.col("stored_at").alias("at"), F.lit(None).cast("string").alias("question_id"),
        F.col("ttl_seconds").cast("bigint").alias("ttl_seconds"), "question")
    moments = asked.unionByName(stored).where("entry is not null and at is not null")
    return moments.withWatermark("at", late).groupBy("entry").transformWithStateInPandas(
        statefulProcessor=_Newest(), outputStructType=REUSED, outputMode="Append", timeMode="EventTime")
