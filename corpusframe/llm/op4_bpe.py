"""Byte-level BPE: encoding by the tiktoken library with a local rank file, and raw-byte decoding."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import bounded

#: Texts above this many characters are cut at safe places before they are encoded.
PIECE_CHARS = 50_000
#: Runs of white space from this length on go to the merger directly: the library's matcher recurses over them.
LONG_SPACE = 5_000

_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACE_RUN = regex.compile(_SPACE + "{%d,}" % LONG_SPACE)
# No match of the pre-split pattern holds a white-space character after another character, and none looks back:
# a text may be cut in front of every white-space character that follows another kind of character.
_SAFE = regex.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS):
    """Consecutive parts of a text whose encodings, joined, are the encoding of the text."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:]


def encode_text(enc, text: str) -> np.ndarray:
    """Token ids of one text of any length."""
    if len(text) <= LONG_SPACE:
        return enc.encode_to_numpy(text, disallowed_special=())
    parts, start = [], 0
    for run in _SPACE_RUN.finditer(text):
        # The pattern takes a whole run at the end of a text, else all of it but the last character.
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text[start : run.start()])]
        parts.append(np.array(enc._encode_single_piece(text[run.start() : end].encode()), np.uint32))
        start = end
    parts += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text[start:])]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _ranks_of(docs: DataFrame, path: str):
    # Under a megabyte, whatever the documents are; workers need no file of their own.
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """Replace the text by ``ids array<int>``, all other columns kept.

    ``path``: a rank file, ``pattern``: what splits a text before merges. Null and empty texts have no ids,
    repeated rows are encoded each, special tokens are ordinary text, and a text of any length is encoded whole.
    An existing column ``ids`` is replaced.
    """
    ranks = _ranks_of(docs, path)
    kept = docs.select(*[c for c in docs.columns if c != "ids"])
    at = kept.columns.index(text_column)

    def work(batches):
        enc = encoder(ranks.value, pattern)
        for batch in bounded(batches, text_column):
            texts = batch.column(at).to_pylist()
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, _lists([encode_text(enc, t or "") for t in texts])], [*names, "ids"])

    out = kept.select(*[c for c in kept.columns if c != text_column], F.array().cast("array<int>").alias("ids")).schema
    return kept.mapInArrow(work, out)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded binary``: the bytes the ``ids`` stand for (they need not be whole characters); null ids give none."""
    ranks = _ranks_of(tokens, path)
    kept = tokens.select(*[c for c in tokens.columns if c != "decoded"])

    def work(batches):
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raw = [enc.decode_bytes(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    return kept.mapInArrow(work, kept.withColumn("decoded", F.lit(b"")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes of every document, encoded and decoded in the same task.

    One row per input row, repeated rows included; null text counts as empty, and an empty table gives an empty one.
    """
    ranks = _ranks_of(docs, path)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches):
        enc = encoder(ranks.value, pattern)
        for batch in bounded(batches, "text"):
            ids = [encode_text(enc, text or "") for text in batch.column("text").to_pylist()]
            raw = [enc.decode_bytes(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(ids), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return source.mapInArrow(work, "doc_id long, ids array<int>, decoded binary")
