"""Language identification by string kernels: presence of blended character n-grams, Nyström landmarks, kernel ridge.

The kernel of two texts is the number of n-grams (n = 1..3, over lower-cased letters, anything else being one blank)
present in both, over the root of the product of how many each has. A text meets only the landmarks: its presence
matrix times the landmarks' gives its kernel row, and that times the ridge coefficients gives one score per language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import bounded, crc_bucket, ids_and_text

#: Cells n-grams are hashed to; the kernel counts shared cells.
CELLS = 1 << 14
#: Training rows: at most so many of a language, and of all languages together.
ROWS_PER_LANGUAGE = 400
TRAINING_ROWS = 8_192
#: Landmarks over all languages.
LANDMARKS = 160
RIDGE = 1e-2
#: Documents of one matrix product.
BLOCK = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point itself if it is a letter, else the blank."""
    table = np.full(0x110000, 32, np.uint32)
    letters = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
    table[letters] = letters
    return table


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x CELLS) presence as bytes, and whether each text holds a letter."""
    lowered = [" " + t.lower() + " " for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = _folded()[np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * (CELLS + 1)
    ends = np.cumsum(sizes) - 1
    flags = np.zeros(len(texts) * (CELLS + 1), np.uint8)
    lettered = np.zeros(len(texts), bool)
    if len(codes):
        lettered = np.logical_or.reduceat(codes != 32, ends - sizes + 1)
    gram = codes.copy()
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x110000) + codes[n - 1 :]
        cell = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
        # What starts at a text's last blanks would reach into the next text.
        for back in range(n - 1):
            last = ends - back
            cell[last[last < len(cell)]] = CELLS
        flags[row[: len(cell)] + cell] = 1
    return flags.reshape(len(texts), CELLS + 1)[:, :CELLS], lettered


def _kernel(flags: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    rows = flags.astype(np.float32)
    rows /= np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
    return rows @ landmarks.T


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray
    slope: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for start in range(0, len(texts), BLOCK):
            flags, lettered = presence([t or "" for t in texts[start : start + BLOCK]])
            if not self.languages:
                names += [UNKNOWN] * len(lettered)
                scores += [0.0] * len(lettered)
                continue
            shares = _shares(_kernel(flags, self.landmarks) @ self.coefficients, self.slope)
            best = shares.argmax(1)
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            scores += [float(s) if ok else 0.0 for s, ok in zip(shares.max(1), lettered)]
        return names, scores


def _shares(margins: np.ndarray, slope: float) -> np.ndarray:
    e = np.exp(slope * (margins - margins.max(1, keepdims=True)).astype(np.float64))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, training) -> Model:
    """Learn from rows where ``training`` holds and lang is not null.

    Takes ROWS_PER_LANGUAGE rows of each language, TRAINING_ROWS in all, by a hash of the id. The driver receives
    their packed presence bits (2 KB a row), never their texts. No such row: a model that knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (
        rows.select("doc_id", "lang").withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= ROWS_PER_LANGUAGE).orderBy("place", "lang", "doc_id").limit(TRAINING_ROWS)
        .select("doc_id", "lang").distinct()
    )
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")

    def bits(batches):
        for batch in bounded(batches, "text"):
            texts = batch.column("text").to_pylist()
            for start in range(0, len(texts), BLOCK):
                flags, lettered = presence(texts[start : start + BLOCK])
                part = batch.slice(start, len(flags))
                packed = pa.array([r.tobytes() for r in np.packbits(flags, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, pa.array(lettered)], ["doc_id", "lang", "bits", "lettered"])

    got = sample.mapInArrow(bits, "doc_id long, lang string, bits binary, lettered boolean").collect()
    got = sorted(((r.lang, r.doc_id if r.doc_id is not None else -1, bytes(r.bits)) for r in got if r.lettered))[: 2 * TRAINING_ROWS]
    languages = sorted({lang for lang, _, _ in got})
    if not languages:
        return Model([], np.zeros((0, CELLS), np.float32), np.zeros((0, 0)), 1.0)
    label = np.array([languages.index(lang) for lang, _, _ in got])
    flags = np.unpackbits(np.frombuffer(b"".join(b for _, _, b in got), np.uint8).reshape(len(got), -1), axis=1)
    random = np.random.default_rng(9)
    each = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([random.permutation(np.flatnonzero(label == k))[:each] for k in range(len(languages))])
    landmarks = flags[chosen].astype(np.float32)
    landmarks /= np.sqrt(np.maximum(landmarks.sum(1, keepdims=True), 1))
    kernel = np.concatenate([_kernel(flags[i : i + BLOCK], landmarks) for i in range(0, len(got), BLOCK)]).astype(np.float64)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    kept = values > values.max() * 1e-6
    to_features = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel @ to_features
    targets = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(label, minlength=len(languages))[label]
    weighted = features * weight[:, None]
    ridge = np.linalg.solve(features.T @ weighted + RIDGE * np.eye(features.shape[1]), weighted.T @ targets)
    coefficients = to_features @ ridge
    margins = kernel @ coefficients
    at = np.arange(len(label))
    # The slope that makes the labelled languages likeliest turns margins into shares.
    slope = max((1.0, 2.0, 3.0, 4.0, 6.0, 8.0), key=lambda s: (np.log(_shares(margins, s)[at, label] + 1e-12) * weight).sum())
    return Model(languages, landmarks, coefficients, slope)


def classify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Add lang_pred string and score double to every row.

    Null texts, empty ones and those without a letter get ``und`` and 0. Repeated rows are predicted each alike;
    existing columns lang_pred and score are replaced; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS x CELLS floats, whatever the input
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    at = kept.columns.index(text_column)

    def work(batches):
        for batch in bounded(batches, text_column):
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(work, kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def training_rows(modulus: int = 3, held_out: int = 1):
    return crc_bucket("doc_id", modulus) != held_out


def identify(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; crc32(doc_id) mod ``modulus`` = ``held_out`` never teaches."""
    model = fit(docs, training_rows(modulus, held_out))
    out = classify(ids_and_text(docs), model)
    return out.select("doc_id", (crc_bucket("doc_id", modulus) == held_out).alias("held_out"), "lang_pred", "score")
