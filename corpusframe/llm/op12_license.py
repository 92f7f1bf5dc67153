"""License notices in whole texts, exact and with a bounded number of edits.

A text is read as its words, joined by one space each. Every notice is cut into one piece more than the edits it
allows, so at least one piece of each acceptable copy stands there unchanged. One pass of an Aho-Corasick automaton
over all pieces finds these seeds; around each, the regex library's bounded-error matching decides whether the notice
stands there, how many edits it took, and where it begins and ends. The base phrases allow no edit: their one piece is
the whole phrase, and only its word boundaries are left to verify.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusframe.llm.common import bounded, ids_and_text, text_bytes


class Notice(NamedTuple):
    """``head`` must stand unchanged before ``text``, which may differ by one edit in every LETTERS_PER_EDIT letters."""

    label: str
    text: str
    head: str = ""

    @property
    def whole(self) -> str:
        return f"{self.head} {self.text}" if self.head else self.text

    @property
    def edits(self) -> int:
        return len(self.whole) // LETTERS_PER_EDIT


#: Letters of a notice for each insertion, deletion or replacement it allows.
LETTERS_PER_EDIT = 10

#: Phrases that count only unchanged, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Short notices and names that are found with edits too.
NOTICES = (
    Notice("gpl", "gnu general public license"),
    Notice("gpl", "free software you can redistribute it and or modify it under the terms of"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl", "gnu affero general public license"),
    Notice("gfdl", "gnu free documentation license"),
    Notice("apache", "apache license"),
    Notice("apache", "you may not use this file except in compliance with the license"),
    Notice("mit", "license", head="mit"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("bsd", "license", head="bsd"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("mpl", "mozilla public license"),
    Notice("epl", "eclipse public license"),
    Notice("boost", "boost software license"),
    Notice("cc-by", "creative commons attribution"),
    Notice("cc-by-nc", "nc 4 0", head="licensed under cc by"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc-by-sa", "sa 4 0", head="licensed under cc by"),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc0", "no rights reserved"),
    Notice("public-domain", "dedicated to the public domain"),
    Notice("no-warranty", "provided as is without warranty of any kind"),
    Notice("all-rights-reserved", "all rights reserved"),
)

# A-Z become a-z, ASCII other than digits and letters a space; all other bytes are parts of words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPANS = "array<struct<label: string, first_word: long, last_word: long, start: long, stop: long, edits: int>>"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    f"score double, spans {SPANS}"
)


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``edits`` + 1 pieces that cover the text, as equal in length as can be."""
    cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def _tools(notices: tuple[Notice, ...], base: tuple[tuple[str, str], ...]):
    """The automaton over all pieces, and a pattern for every notice."""
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        for offset, piece in pieces(notice.whole, notice.edits):
            seeds.setdefault(piece, []).append((i, offset))
    # Base phrases are numbered from -1 downwards.
    for i, (phrase, _) in enumerate(base):
        seeds.setdefault(phrase, []).append((-1 - i, 0))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    patterns = []
    for notice in notices:
        head = regex.escape(notice.head + " ") if notice.head else ""
        patterns.append(regex.compile(rf"(?b)(?<= ){head}(?:{regex.escape(notice.text)}){{e<={notice.edits}}}(?= )"))
    return automaton, patterns


class Found(NamedTuple):
    """Places count letters in the plain text: its words, a space before each and one at the end."""

    n_words: int
    plain: str
    #: (label, start, stop) of every base phrase.
    base: list[tuple[str, int, int]]
    #: (label, start, stop, edits) of notices; those of one notice don't overlap, the earlier one counts.
    spans: list[tuple[str, int, int, int]]


def find(raw: bytes, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE, known: dict | None = None) -> Found:
    """Base phrases and notices of one text. ``known`` keeps verdicts, so a passage that recurs is verified once."""
    known = {} if known is None else known
    words = raw.translate(_PLAIN).split()
    plain = " " + b" ".join(words).decode("utf-8", "replace") + " "
    automaton, patterns = _tools(notices, base)
    phrases, places = [], [[] for _ in notices]
    for end, (size, uses) in automaton.iter(plain):
        for i, offset in uses:
            start = end + 1 - size - offset
            if i >= 0:
                places[i].append(start)
            elif plain[start - 1] == " " and plain[end + 1] == " ":
                phrases.append((base[-1 - i][1], start, end + 1))
    spans = []
    for i, starts in enumerate(places):
        notice, last = notices[i], 0
        for start in sorted(set(starts)):
            # Wherever the notice begins and ends if this piece of it is unchanged, and the spaces around it.
            low = max(start - notice.edits - 1, last)
            window = plain[low : start + len(notice.whole) + notice.edits + 1]
            if (i, window) not in known:
                match = patterns[i].search(window)
                known[i, window] = match and (match.start(), match.end(), sum(match.fuzzy_counts))
            if verdict := known[i, window]:
                spans.append((notice.label, low + verdict[0], low + verdict[1], verdict[2]))
                last = low + verdict[1]
    return Found(len(words), plain, phrases, sorted(spans, key=lambda s: (s[1], s[2], s[0])))


def _row(raw: bytes, notices: tuple[Notice, ...], base: tuple[tuple[str, str], ...], known: dict) -> tuple:
    found = find(raw, notices, base, known)
    if not found.base and not found.spans:
        return found.n_words, 0, None, None, "", "", 0.0, []
    spaces = np.flatnonzero(np.frombuffer(found.plain.encode("utf-32-le"), np.uint32) == 32)
    word = lambda place: int(np.searchsorted(spaces, place)) - 1  # noqa: E731  the word that this place lies in
    at = [word(start) for _, start, _ in found.base]
    spans = [(label, word(start), word(stop - 1), edits, stop - start) for label, start, stop, edits in found.spans]
    base_labels = {label for label, *_ in found.base}
    score = 1.0 if found.base else max(1 - edits / max(size, edits, 1) for *_, edits, size in spans)
    places = _original_places(raw, {w for _, a, b, *_ in spans for w in (a, b)})
    told = [
        {"label": label, "first_word": a, "last_word": b, "start": places[a][0], "stop": places[b][1], "edits": edits}
        for label, a, b, edits, _ in spans
    ]
    return (
        found.n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {label for label, *_ in spans})), score, told,
    )


def _original_places(raw: bytes, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """First and next code point of the wanted words in the text as it was."""
    letters = np.frombuffer(raw.translate(_PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letters, [False]]).astype(np.int8)))
    # Code points before a byte: all bytes before it but those that continue one.
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return {w: (int(points[edges[2 * w]]), int(points[edges[2 * w + 1]])) for w in wanted}


def scan(
    docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Words, base phrases, labels, a score and the spans of all notices of every whole text.

    n_base counts all places of base phrases, overlaps included; first_word and last_word are their smallest and
    largest start, in words from 0 (null: none). labels holds the base labels and those of notices. score is 1 where a
    base phrase stands, else 1 less the share of edited letters in the best notice, 0 without one. spans has a row for
    each notice: words, code points of the original text from ``start`` up to ``stop``, and edits.
    A null text is empty: no words, no labels. Every row has its own result, ids repeated or null included; other
    columns are not read; an empty table has no rows.
    """

    def work(batches):
        for batch in bounded(batches, "text"):
            known: dict = {}
            rows = [_row(raw, notices, base, known) for raw in text_bytes(batch.column("text"))]
            fields = pa.schema([
                ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                ("spans", pa.list_(pa.struct([
                    ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))),
            ])
            arrays = [pa.array(column, field.type) for column, field in zip(zip(*rows), fields)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *fields.names])

    return ids_and_text(docs, id_column, text_column).mapInArrow(work, SCHEMA)
