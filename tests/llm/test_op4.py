import hashlib

import pytest

from corpusframe.llm import op4_bpe as bpe
from corpusframe.llm.queries import QUERIES, _vocabulary

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def enc():
    path, pattern = _vocabulary()
    return bpe.encoder(open(path, "rb").read(), pattern)


@pytest.mark.parametrize("text", [
    "", " ", "\n\n  x", "a" * 30, "it's we'll   there \n\n\t x1y2 é漢字 🙂🙂 \x1c \x85y", "<|endoftext|> tail ",
])
def test_pieces_and_long_forms_equal_the_library(enc, text):
    for whole in (text, (text + " ") * 700 if text.strip() else text):
        want = enc.encode_ordinary(whole)
        assert bpe.encode_text(enc, whole).tolist() == want
        assert [i for p in bpe.safe_pieces(whole, 11) for i in enc.encode_ordinary(p)] == want


@pytest.mark.parametrize("text", ["x" + " " * 9000 + "y z", " " * 6000 + "\n" * 6000, "w" * 7000 + "\t" * 6000 + "v", "a b " * 40000])
def test_long_runs(enc, text):
    assert bpe.encode_text(enc, text).tolist() == enc.encode_ordinary(text)


def test_a_run_the_library_cannot_match(enc):
    ids = bpe.encode_text(enc, " " * 1_200_000 + "x")
    assert enc.decode_bytes(ids.tolist()) == b" " * 1_200_000 + b"x"


def test_rows(spark, enc):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "ü"), (4, "word " * 60_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    path, pattern = _vocabulary()
    wide = df.selectExpr("doc_id", "text", "1 AS ids", "'x' AS decoded", "2 AS n_tokens")
    got = bpe.round_trip(wide, path, pattern).collect()
    assert sorted(((r.doc_id or 0), bytes(r.decoded).decode()) for r in got) == sorted(((i or 0), t or "") for i, t in rows)
    assert all(list(r.ids) == enc.encode_ordinary(bytes(r.decoded).decode()) for r in got)
    two = bpe.decode(bpe.encode(wide, path, pattern), path, pattern)
    assert two.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(bytes(r.decoded) for r in two.collect()) == sorted(bytes(r.decoded) for r in got)
    assert bpe.round_trip(df.limit(0), path, pattern).count() == 0


def test_query_equals_the_library(spark, enc):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op4_bpe"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        text = row.text or ""
        ids = enc.encode_ordinary(text)
        have = got[row.doc_id]
        assert have.n_tokens == len(ids)
        assert have.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert have.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
