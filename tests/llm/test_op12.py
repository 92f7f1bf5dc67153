import re

import pytest
from pyspark.sql import functions as F

from corpusframe.llm import op12_license as lic
from corpusframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def base_by_hand(text):
    got, have = [], words(text)
    for phrase, label in lic.BASE:
        want = phrase.split()
        got += [(i, label) for i in range(len(have) - len(want) + 1) if have[i : i + len(want)] == want]
    at = [i for i, _ in got]
    return len(have), len(got), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in got}))


def edits(have, want):
    """Edit distance."""
    row = list(range(len(want) + 1))
    for i, a in enumerate(have, 1):
        row, left = [i], row
        for j, b in enumerate(want, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (a != b)))
    return row[-1]


def labels_by_hand(text):
    """Labels of every run of whole words that is near enough to a notice, by trying all of them."""
    have, out = words(text), set(filter(None, base_by_hand(text)[4].split(",")))
    for notice in lic.NOTICES:
        head, most = notice.head.split(), len(notice.whole.split()) + notice.edits
        for a in range(len(have)):
            if have[a : a + len(head)] != head:
                continue
            for b in range(a + len(head) + 1, min(a + most, len(have)) + 1):
                run = " ".join(have[a + len(head) : b])
                if abs(len(run) - len(notice.text)) <= notice.edits and edits(run, notice.text) <= notice.edits:
                    out.add(notice.label)
    return ",".join(sorted(out))


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op12_license"](spark, FOLDER).collect()
    assert len(got) == len(texts) and sum(r.n_base > 0 for r in got) >= 3
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(texts[r.doc_id])
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    for r in got:
        if r.labels or len(texts[r.doc_id]) < 400:
            assert r.labels == labels_by_hand(texts[r.doc_id])


@pytest.mark.parametrize("seed", range(4))
def test_edited_notices_equal_brute_force(seed):
    import random

    rng = random.Random(seed)
    for _ in range(20):
        notice = rng.choice(lic.NOTICES)
        letters = list("see " * rng.randrange(3) + notice.whole + rng.choice(["", " now", "s", " 4 0 x"]))
        for _ in range(rng.randrange(notice.edits + 3)):
            i = rng.randrange(len(letters))
            letters[i : i + 1] = rng.choice([[], [letters[i], "x"], ["q"], [" ", letters[i]], ["é"]])
        text = "".join(letters)
        row = lic._row(text.encode(), lic.NOTICES, lic.BASE, {})
        assert row[5] == labels_by_hand(text), text


def test_pieces_cover_and_one_stays():
    for notice in lic.NOTICES:
        parts = lic.pieces(notice.whole, notice.edits)
        assert "".join(p for _, p in parts) == notice.whole and len(parts) == notice.edits + 1
        assert all(len(p) >= 5 for _, p in parts)


def test_spans_point_into_the_text():
    text = "Ünder — Licenced under the\nApache  Licence, v2. All rights   RESERVED!"
    row = lic._row(text.encode(), lic.NOTICES, lic.BASE, {})
    assert [(s["label"], text[s["start"] : s["stop"]], s["edits"]) for s in row[7]] == [
        ("apache", "Apache  Licence", 1), ("all-rights-reserved", "All rights   RESERVED", 0)]
    assert row[4] == "" and row[5] == "all-rights-reserved,apache" and row[6] == 1.0


def test_strange_rows(spark):
    rows = [(1, None), (1, ""), (None, "MIT License"), (2, "mit license " * 20_000), (2, "mit license"), (3, "permit license kit license"),
            (4, "cc by cc by-nc"), (5, "é" * 100_000), (6, "apache license"), (7, "licen" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("labels", "score", "n_words", "spans")})
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in lic.scan(df).collect())
    assert got == sorted((str(i), *base_by_hand(t), labels_by_hand(t) if len(t or "") < 1000 else "mit" if "mit" in t else "") for i, t in rows)
    assert lic.scan(df.limit(0)).count() == 0
