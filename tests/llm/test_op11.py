import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusframe.llm import op11_merkle as merkle
from corpusframe.llm.queries import ORACLES, QUERIES
from oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(levels, place, folded):
    """The siblings of a leaf and the digest its climb ends with."""
    proof = ""
    for level in levels[:-1]:
        run = level[place - place % 8 : place - place % 8 + 8]
        others = run[: place % 8], run[place % 8 + 1 :]
        proof, folded, place = proof + "".join(others[0] + others[1]), digest(*others[0], folded, *others[1]), place // 8
    return proof, folded


def build(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def by_hand(rows):
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {n: build([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    top = build([built[n][-1][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for place, (_, _, own, row) in enumerate(sorted(trees[n], key=lambda x: x[:3])):
            hit = zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 3 == 0
            seen = leaf(row, row[4].translate(low) if hit and row[4] is not None else row[4])
            lower, folded = climb(built[n], place, seen)
            upper, folded = climb(top, i, folded)
            out.append((row[0], own, built[n][-1][0], top[-1][0], digest(lower + upper), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({c: F.lit("x") for c in ("row", "leaf", "tree", "pos", "seen", "root", "_part", "_key", "level")})
    got = merkle.verify(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows)


def test_query_equals_its_sql(spark):
    assert differences(spark, connect(FOLDER), QUERIES["op11_merkle"], ORACLES["op11_merkle"], FOLDER) is None


def test_strange_rows(spark):
    rows = [(i, f"s{i % 3}", "en" if i % 2 else "de", i, f"Text {i} É") for i in range(1200)]
    rows += [(5000 + i, None, f"l{i:02}", None, "ONE leaf") for i in range(12)]
    rows += [(7, "s", "en", 1, "Repeated"), (7, "s", "en", 1, "Repeated"), (7, "s", "en", 1, "other"), (None, None, None, None, None), (None, "", "", 0, ""), (-3, "Ü", None, 9, "A" * 200_000), (30, "s", "EN", 2, None)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 8, 9])
def test_small_tables(spark, n):
    check(spark, [(i, "s", "en", i, "T") for i in range(n)])


def test_empty_table(spark):
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_nodes_are_copied(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN_IN", 16)
    check(spark, [(i, "s", None if i % 5 == 0 else "en" if i % 2 else f"x{i}", i, "T") for i in range(200)])
