"""Quality rules: fixed limits on rule statistics, then an isolation forest over them.

Every tree of the forest is grown on rows drawn from all labelled good documents with a few bad ones among them (so that
there is something to split off); a document that random splits separate early is unlike good ones. How early is too
early is calibrated on all labelled rows: the limit that finds most bad ones while nearly all good ones stay. Without
labels the forest is grown on any documents and rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import SPACES, bounded, ids_and_text, stored, text_bytes
from corpusframe.operators.scale import in_ranges

SYMBOLS = b"#*$%&|<>"
#: Words of one window in the repeat rule.
WINDOW = 5
#: Bad rows among the good ones of a tree's sample.
BAD_SHARE = 0.02
TREES = 100
ROWS_PER_TREE = 256
#: Share of the labelled good documents that a limit may reject at most.
LOST_GOOD = 0.005

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_chars", "n_lines", "n_distinct", "n_digits", "n_upper", "n_stops"]
STATISTICS = COUNTS + EXTRA
#: What ``rules`` makes of them.
FEATURES = 10

_CONTINUATION = bytes(range(0x80, 0xC0))
_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STOPS = b".,;:!?"


def _without(text: bytes, removed: bytes) -> int:
    return len(text.translate(None, removed))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions inside windows of ``window`` ids that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids.astype(np.int64)
    if len(ids) == int(key.max()) + 1:
        return 0
    for step in range(1, window):
        # Ranks of ever longer windows; a rank stays below the number of words.
        key = key[:-1] * (len(ids) + 1) + ids[step:]
        if step < window - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics_of(text: bytes) -> tuple:
    """The counts of one text, in the order of STATISTICS."""
    words = text.split()
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    bare = text.translate(None, SPACES)
    return (
        len(words), _without(bare, _CONTINUATION), len(bare) - _without(bare, SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(ids),
        _without(text, _CONTINUATION), len(lines), len(known), len(bare) - _without(bare, _DIGITS),
        len(bare) - _without(bare, _UPPER), len(bare) - _without(bare, _STOPS),
    )


def rules(counts: dict) -> np.ndarray:
    """(documents x features): what the forest sees, independent of a document's length but for the first."""
    c = {name: np.asarray(values, np.float64) for name, values in counts.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    shares = np.column_stack([
        c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_digits"] / chars, c["n_upper"] / chars, c["n_stops"] / words,
    ])
    # Splits are drawn evenly over a feature's range: on this scale a share of nothing is far from a small share.
    return np.column_stack([
        np.log(shares + 0.01), np.log1p(c["n_words"]), np.log1p(c["word_chars"] / words),
        np.log1p(c["n_distinct"]) / np.log1p(words), np.log1p(c["n_chars"] / np.maximum(c["n_lines"], 1)),
    ])


def telling(rows: DataFrame) -> np.ndarray:
    """How often each feature is split on: by how well it alone orders good and bad rows, all alike without both.

    ``rows``: (good, features array), all labelled ones.
    """
    one = rows.select("good", F.posexplode("features").alias("feature", "value"))
    told = _upto(one).groupBy("feature").agg(
        F.sum(F.col("n_bad") * (F.col("good_upto") - F.col("n_good") / 2)).alias("below"),
        F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad")).orderBy("feature").toPandas()
    if not len(told) or not told["good"][0] or not told["bad"][0]:
        return np.full(FEATURES, 1 / FEATURES)
    apart = (2 * (told["below"].astype(float) / told["bad"]) / told["good"] - 1).abs().to_numpy()
    apart = np.maximum(apart, 0.02) ** 2
    return apart / apart.sum()


def _upto(rows: DataFrame) -> DataFrame:
    """feature, value, n_good, n_bad of rows (good, feature, value), with good_upto and bad_upto: at that value or below.

    Values lie in ranges and only counts per range meet in one task.
    """
    n = rows.groupBy("feature", "value").agg(
        F.count(F.when(F.col("good"), 1)).alias("n_good"), F.count(F.when(~F.col("good"), 1)).alias("n_bad"))
    ranged = in_ranges(n, [F.col("feature"), F.col("value")])
    earlier = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("feature", "_range").agg(F.sum("n_good").alias("g"), F.sum("n_bad").alias("b")).select(
        "feature", "_range", F.coalesce(F.sum("g").over(earlier), F.lit(0)).alias("g"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b"))
    inside = Window.partitionBy("feature", "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumns({"_good": F.sum("n_good").over(inside), "_bad": F.sum("n_bad").over(inside)}).join(before, ["feature", "_range"]).select(
        "feature", "value", "n_good", "n_bad", (F.col("_good") + F.col("g")).alias("good_upto"), (F.col("_bad") + F.col("b")).alias("bad_upto"))


def _usual_depth(n):
    """Mean depth of a search among n rows: what is left below a leaf that holds n."""
    n = np.asarray(n, np.float64)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


@dataclass(frozen=True)
class Forest:
    """Trees in arrays: feature (-1: leaf), split value, left child (right is the next), depth at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    usual: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher for rows that are separated earlier."""
        total = np.zeros(len(rows))
        at_all = np.arange(len(rows))
        for tree in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            while True:
                feature = self.feature[tree][node]
                inner = feature >= 0
                if not inner.any():
                    break
                go = at_all[inner]
                right = rows[go, feature[inner]] >= self.value[tree][node[inner]]
                node[go] = self.left[tree][node[inner]] + right
            total += self.depth[tree][node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9))


def grow(rows: np.ndarray, few: np.ndarray | None = None, often: np.ndarray | None = None, trees: int = TREES, size: int = ROWS_PER_TREE, seed: int = 1) -> Forest:
    """Trees over samples of ``rows``, with BAD_SHARE of them from ``few``, features split on in the shares ``often``."""
    random = np.random.default_rng(seed)
    size = min(size, len(rows))
    strange = 0 if few is None or not len(few) else max(1, round(size * BAD_SHARE))
    limit = int(np.ceil(np.log2(max(size, 2))))
    arrays = []
    for _ in range(trees):
        sample = rows[random.permutation(len(rows))[:size]]
        if strange:
            sample = np.concatenate([sample[strange:], few[random.integers(len(few), size=strange)]])
        feature, value, left, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, np.arange(len(sample)), 0)]
        while todo:
            node, held, level = todo.pop()
            low, high = (sample[held].min(0), sample[held].max(0)) if len(held) else (np.zeros(1), np.zeros(1))
            open_features = np.flatnonzero(high > low)
            if level >= limit or not len(open_features):
                depth[node] = level + float(_usual_depth(len(held)))
                continue
            odds = None if often is None else often[open_features] / often[open_features].sum()
            f = int(random.choice(open_features, p=odds))
            cut = random.uniform(low[f], high[f])
            feature[node], value[node], left[node] = f, cut, len(feature)
            beyond = sample[held, f] >= cut
            for side in (False, True):
                todo.append((len(feature), held[beyond == side], level + 1))
                feature.append(-1), value.append(0.0), left.append(0), depth.append(0.0)
        arrays.append((np.array(feature), np.array(value), np.array(left), np.array(depth)))
    return Forest(*([a[i] for a in arrays] for i in range(4)), usual=float(_usual_depth(size)))


def calibrate(scores: np.ndarray, good: np.ndarray, lost: float = LOST_GOOD) -> float:
    """The score above which documents go: most bad ones found while at most ``lost`` of the good ones go.

    Without labels of both kinds nothing goes. ``calibrated`` is the same over a table.
    """
    if not good.any() or good.all():
        return 1.0
    limits = np.unique(scores)
    gone_good = 1 - np.searchsorted(np.sort(scores[good]), limits, "right") / good.sum()
    gone_bad = 1 - np.searchsorted(np.sort(scores[~good]), limits, "right") / (~good).sum()
    worth = np.where(gone_good <= lost, gone_bad - gone_good, -1)
    # Equal worth: the highest limit, which rejects least.
    return float(limits[len(limits) - 1 - worth[::-1].argmax()])


def calibrated(scored: DataFrame, lost: float = LOST_GOOD) -> float:
    """``calibrate`` over all rows (good, score) of a table."""
    total = scored.agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad")).first()
    if not total.good or not total.bad:
        return 1.0
    upto = _upto(scored.select("good", F.lit(0).alias("feature"), F.col("score").alias("value")))
    gone_good, gone_bad = 1 - F.col("good_upto") / total.good, 1 - F.col("bad_upto") / total.bad
    worth = F.when(gone_good <= lost, gone_bad - gone_good).otherwise(-1)
    # Equal worth: the highest limit, which rejects least.
    return upto.select("value", worth.alias("worth")).orderBy(F.desc("worth"), F.desc("value")).first().value


def base_failed(counts: dict) -> np.ndarray:
    words = np.asarray(counts["n_words"])
    return (words < 10) | (100 * np.asarray(counts["n_repeat_words"]) > 20 * words)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text: words are runs outside ASCII white space; null text counts as empty."""

    def work(batches):
        for batch in bounded(batches, "text"):
            rows = [statistics_of(t) for t in text_bytes(batch.column("text"))]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *STATISTICS])

    return ids_and_text(docs).mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS))


def _drawn(rows: DataFrame, which: Column) -> np.ndarray:
    """Features of the rows a forest's trees are grown on: as many of all rows, by hash, as TREES samples hold."""
    names = ["doc_id", *STATISTICS]
    some = rows.where(which).select(names).orderBy(F.xxhash64(*names), *names).limit(TREES * ROWS_PER_TREE).toPandas().sort_values(names)
    return rules(some)


def _with_features(counted: DataFrame) -> DataFrame:
    """good, and what the forest sees, of rows (good, STATISTICS)."""

    def work(batches):
        for batch in batches:
            seen = rules({c: batch.column(c).to_numpy() for c in STATISTICS})
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(list(seen), pa.list_(pa.float64()))], ["good", "features"])

    return counted.select("good", *STATISTICS).mapInArrow(work, "good boolean, features array<double>")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, score (of the forest) and kept for every document.

    ``labels``: doc_id and quality (1 good, 0 bad); null ones teach nothing, and of several the least counts. Every
    document is measured once and its counts are stored. How telling features are and the limit come from all labelled
    documents that pass the base rules; every tree has its ROWS_PER_TREE drawn from all of them, as the method asks.
    Documents without a word fail the base rules; repeated rows are judged alike; an empty table gives an empty one.
    """
    counted = stored(measured(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    # Only what the fixed limits let through is compared: the forest looks for what they do not see.
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    taught = stored(counted.where(~failed).join(known, "doc_id"))
    good = _drawn(taught, F.col("good"))
    if len(good):
        features = stored(_with_features(taught))
        forest = grow(good, _drawn(taught, ~F.col("good")), telling(features))
        limit = calibrated(_scored(features, forest))
    else:
        anything = _drawn(counted, F.col("doc_id").isNotNull())
        forest, limit = grow(anything if len(anything) else np.zeros((1, 1))), 1.0
    shared = docs.sparkSession.sparkContext.broadcast((forest, limit))  # TREES trees of ROWS_PER_TREE rows

    def work(batches):
        model, most = shared.value
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in STATISTICS}
            failed, score = base_failed(counts), model.score(rules(counts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed), pa.array(score), pa.array(~failed & (score <= most))],
                ["doc_id", *STATISTICS, "base_failed", "score", "kept"])

    return counted.mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS) + ", base_failed boolean, score double, kept boolean")


def _scored(features: DataFrame, forest: Forest) -> DataFrame:
    """good, score of rows (good, features)."""
    shared = features.sparkSession.sparkContext.broadcast(forest)

    def work(batches):
        for batch in batches:
            seen = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(shared.value.score(seen))], ["good", "score"])

    return features.mapInArrow(work, "good boolean, score double")
