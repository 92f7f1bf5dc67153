"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and a cascade of small transducers rewrites each clause's words: the lexical one gives
insults and threats (with weights), targets, negations and reporting words; the next ones mark what stands in the
scope of a negation, in reported speech, or near a target. A clause accepts as events of a class (insult or threat,
aimed or not, plain, negated or reported); the classes' weighted sums, not single words, make the score.

The insult lexicon and the classes' weights are learned from labelled rows; the small closed word classes are fixed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import bounded, crc_bucket, ids_and_text, settle

#: Labelled rows, by hash of the id, everything is learned from.
LABELLED_ROWS = 16_000
#: Terms of the learned lexicon, strongest first.
LEXICON_TERMS = 4_000
#: A term is learned from so many toxic texts at least, with this likelihood ratio (G²) and share of toxic texts.
LEAST_TEXTS, LEAST_RATIO, LEAST_SHARE = 4, 30.0, 0.8
#: Log odds of a term that weighs a whole event.
WHOLE_ODDS = 6.0
#: Orders of the signatures that tell copies in the sample.
PERMUTATIONS = 8
#: Word beginnings of these lengths are terms too: one stem may have many endings.
STEMS = (4, 5, 6)
THRESHOLD = 0.3

#: Words a negation reaches, and words between a target and what is aimed at it.
NEGATION_SCOPE, TARGET_SCOPE = 3, 4

NEGATIONS = set("not no never neither nor isn aren wasn don doesn nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ni tampoco".split())
REPORTS = set("said says say saying called calls told wrote quoted quote claimed sagte sagt schrieb nannte behauptete dit disait écrit appelé dijo dice escribió llamó".split())
TARGETS = set("you your yours yourself he she they them du dich dir euch ihr dein tu toi vous ton votre tú ti usted ustedes vosotros".split())
THREATS = set("kill hurt destroy beat burn stab shoot strangle töten umbringen verletzen zerstören tuer frapper détruire brûler matar golpear destruir quemar".split())

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)


@dataclass(frozen=True)
class Symbol:
    """What the cascade rewrites: a tag, its weight, and the marks set on the way."""

    tag: int
    weight: float = 0.0
    marks: frozenset = frozenset()


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: arcs lead from (state, tag) to (state, mark set on the symbol, factor of its weight)."""

    arcs: dict = field(hash=False)

    def run(self, symbols: list[Symbol]) -> list[Symbol]:
        state, out = 0, []
        for symbol in symbols:
            state, mark, factor = self.arcs.get((state, symbol.tag), (state, None, 1.0))
            out.append(Symbol(symbol.tag, symbol.weight * factor, symbol.marks | {mark}) if mark else symbol)
        return out


def _scope(opener: int, mark: str, length: int | None, factor: float = 1.0) -> Transducer:
    """Marks insults and threats within ``length`` words after an opener (None: to the end of the clause)."""
    last = length or 1
    arcs = {}
    for state in range(last + 1):
        arcs[state, opener] = (last, None, 1.0)
        following = state if length is None else max(0, state - 1)
        for tag in range(6):
            if tag != opener:
                hit = state and tag in (INSULT, THREAT)
                arcs[state, tag] = (following, mark if hit else None, factor if hit else 1.0)
    return Transducer(arcs)


NEGATED = _scope(NEGATION, "negated", NEGATION_SCOPE)
REPORTED = _scope(REPORT, "reported", None)
#: Run once from either end.
AIMED = _scope(TARGET, "aimed", TARGET_SCOPE)

CLASSES = [(tag, aimed, way) for tag in (INSULT, THREAT) for aimed in (False, True) for way in ("plain", "negated", "reported")]
#: Log odds of a whole event of each class before labels speak: insults count, threats need a target, others hardly do.
PRIOR = np.array([3.0, 0.3, 0.8, 4.0, 0.4, 1.0, 0.2, 0.0, 0.1, 2.0, 0.2, 0.5])
BASE = -4.0


@dataclass(frozen=True)
class Grammar:
    """words and stems: weights in (0, 1] of learned insults; weights: log odds per class; base: of a text without events."""

    words: dict
    stems: dict
    weights: np.ndarray = field(default_factory=lambda: PRIOR)
    base: float = BASE

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for size in STEMS:
            if len(word) >= size:
                found = max(found, self.stems.get(word[:size], 0.0))
        return found

    def lexical(self, word: str) -> Symbol:
        weight = self.insult(word)
        if weight:
            return Symbol(INSULT, weight)
        if word in THREATS:
            return Symbol(THREAT, 1.0)
        for words, tag in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if word in words:
                return Symbol(tag)
        return Symbol(OTHER)

    def events(self, clause: list[str]) -> list[tuple[int, float]]:
        """(class, weight) of every insult and threat of one clause."""
        symbols = REPORTED.run(NEGATED.run([self.lexical(w) for w in clause]))
        symbols = AIMED.run(AIMED.run(symbols)[::-1])[::-1]
        out = []
        for s in symbols:
            if s.tag in (INSULT, THREAT):
                way = "reported" if "reported" in s.marks else "negated" if "negated" in s.marks else "plain"
                out.append((CLASSES.index((s.tag, "aimed" in s.marks, way)), s.weight))
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Per class the root of the summed weights: the second insult adds less than the first."""
        sums = np.zeros(len(CLASSES))
        lowered = (text or "").lower()
        hits = {w for w in set(_WORD.findall(lowered)) if w in THREATS or self.insult(w)}
        if not hits:
            return sums
        clause: list[str] = []
        for token in [*_TOKEN.findall(lowered), "."]:
            if token in ".!?;\n":
                if not hits.isdisjoint(clause):
                    for kind, weight in self.events(clause):
                        sums[kind] += weight
                clause = []
            else:
                clause.append(token)
        return np.sqrt(sums)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + rows @ self.weights)))


def terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    out = {"w" + w for w in words if len(w) > 2}
    for size in STEMS:
        out.update("s" + w[:size] for w in words if len(w) >= size)
    return out


def ratio(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Likelihood ratio (G²) of a term's table against independence."""
    cells = [(toxic, all_toxic), (clean, all_clean), (all_toxic - toxic, all_toxic), (all_clean - clean, all_clean)]
    share = (toxic + clean) / (all_toxic + all_clean)
    return 2 * sum(n * math.log(n / (of * (share if i < 2 else 1 - share))) for i, (n, of) in enumerate(cells) if n)


def lexicon(counts: list[tuple[str, int, int]], all_toxic: int, all_clean: int) -> tuple[dict, dict]:
    """Words and stems that tell toxic texts, with their log odds over those of a whole event."""
    scored = []
    for term, toxic, clean in counts:
        strength = ratio(toxic, clean, all_toxic, all_clean)
        share = (toxic / all_toxic) / (toxic / all_toxic + (clean + 0.5) / (all_clean + 1))
        if toxic >= LEAST_TEXTS and strength >= LEAST_RATIO and share >= LEAST_SHARE:
            scored.append((strength, term, min(1.0, math.log(share / (1 - share)) / WHOLE_ODDS)))
    scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:LEXICON_TERMS]
    words = {t[1:]: s for _, t, s in scored if t[0] == "w"}
    stems = {t[1:]: s for _, t, s in scored if t[0] == "s"}
    return words, stems


def signatures(text: str) -> list[int]:
    """Smallest hashes of a text's word pairs under PERMUTATIONS orders: near copies share nearly all of them."""
    words = _WORD.findall(text.lower())
    hashes = np.array([xxhash.xxh64_intdigest(a + " " + b) for a, b in zip(words, words[1:] or [""])] or [0], np.uint64)
    return [int((hashes * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min() >> np.uint64(1)) for k in range(PERMUTATIONS)]


def _sample(docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """(text, toxic) of the bounded labelled sample. Of texts that share half their signatures one speaks for all,
    else the words that a group of copies happens to hold would pass for telling ones."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(training)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(LABELLED_ROWS).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def sign(batches):
        for batch in bounded(batches, "text"):
            marks = pa.array([signatures(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], [*batch.schema.names, "marks"])

    texts = settle(ids_and_text(docs).join(F.broadcast(picked), "doc_id").where("text IS NOT NULL").mapInArrow(sign, "doc_id long, text string, toxic int, marks array<long>"))
    seen: Counter = Counter()
    speakers = []
    # LABELLED_ROWS rows of a few numbers; ids that repeat in the documents speak together.
    for r in sorted(texts.select("doc_id", "marks").collect(), key=lambda r: (r.doc_id, r.marks)):
        keys = [(k, m) for k, m in enumerate(r.marks)]
        if sum(seen[k] > 0 for k in keys) < PERMUTATIONS / 2:
            speakers.append((r.doc_id,))
        seen.update(keys)
    spoken = docs.sparkSession.createDataFrame(sorted(set(speakers)), "doc_id long")
    return texts.join(F.broadcast(spoken), "doc_id", "left_semi").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, training) -> Grammar:
    """Learn lexicon and weights from at most LABELLED_ROWS labelled rows where ``training`` holds.

    Terms are counted by texts where the texts are, partial counts are added up by term, and only terms that pass
    the test reach the driver. Without labels of both kinds the grammar has its fixed words and prior weights only.
    """
    sample = _sample(docs, labels, training)

    def count(batches):
        for batch in bounded(batches, "text"):
            toxic, clean, sizes, seen = Counter(), Counter(), [0, 0], set()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text in seen:
                    continue
                seen.add(text)
                sizes[1 - label] += 1
                (toxic if label else clean).update(terms_of(text))
            names = [*toxic.keys(), *(clean.keys() - toxic.keys()), ""]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([toxic[n] for n in names[:-1]] + [sizes[0]], pa.int64()), pa.array([clean[n] for n in names[:-1]] + [sizes[1]], pa.int64())],
                ["term", "toxic", "clean"])

    counted = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # What cannot pass stays where it is: too few toxic texts, or more clean than toxic ones.
    rows = counted.where((F.col("term") == "") | ((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") > F.col("clean") / 4))).orderBy(F.col("term") != "", F.col("toxic").desc(), "term").limit(20 * LEXICON_TERMS).collect()
    totals = next(((r.toxic, r.clean) for r in rows if r.term == ""), (0, 0))
    if not all(totals):
        return Grammar({}, {})
    grammar = Grammar(*lexicon([(r.term, r.toxic, r.clean) for r in rows if r.term], *totals))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def events(batches):
        for batch in bounded(batches, "text"):
            rows = [list(shared.value.features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = sorted((tuple(r.x), r.y) for r in sample.mapInArrow(events, "x array<double>, y int").collect())
    x, y = np.array([g[0] for g in got]).reshape(len(got), len(CLASSES)), np.array([g[1] for g in got], np.float64)
    weights, base = _regress(x, y)
    return Grammar(grammar.words, grammar.stems, weights, base)


def _regress(x: np.ndarray, y: np.ndarray, pull: float = 0.5, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression drawn to the prior weights, by Newton steps; no event lowers a score."""
    rows = np.column_stack([x, np.ones(len(x))])
    prior = np.append(PRIOR, BASE)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (p - y) + pull * (w - prior)
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + pull * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score in (0, 1) and predicted (1 from ``threshold`` on) of every whole text.

    Null and empty texts get the score of a text without events; repeated rows score alike; an empty table gives an
    empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # at most LEXICON_TERMS terms

    def work(batches):
        for batch in bounded(batches, "text"):
            model = shared.value
            scores = model.score(np.array([model.features(t) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, len(CLASSES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return ids_and_text(docs).mapInArrow(work, "doc_id long, score double, predicted int")


def rate(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod ``modulus`` is ``held_out`` never teach."""
    grammar = fit(docs, labels, crc_bucket("doc_id", modulus) != held_out)
    out = score(docs, grammar)
    return out.select("doc_id", (crc_bucket("doc_id", modulus) == held_out).alias("held_out"), "score", "predicted")
