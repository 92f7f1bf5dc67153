"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to DEPTH preceding words. A context is a candidate once it was seen often enough, and is
retained if its next-symbol distribution diverges enough from that of its longest retained suffix. Distributions are
smoothed towards that suffix in proportion to how many different symbols follow, down to the add-one counts of single
tokens. A token is scored by the longest retained state that its preceding words end in.

The tree is never laid out. Packs of documents ask, in blocks, how often their grams occur in training documents, how
many symbols follow each of their contexts, and what those contexts gain; all three are sums over packs. From the answers
a pack knows the probability of each of its grams by the states that concern it. Words are known by a 64-bit hash.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.blocks import ASKS, answered, blocks, distinct, expand, gathered, read_answers, share_bits
from corpusframe.llm.common import crc_rest, from_blob, ids_and_text, in_buckets, text_bytes, text_size, to_blob

#: Longest context, in words.
DEPTH = 2
#: Training occurrences from which on a context is a candidate.
LEAST_SEEN = 16
#: Nats that a context has to gain over its suffix, per different symbol that follows it.
LEAST_GAIN = 1.0
MODULUS, HELD_OUT = 7, 2
#: Text of one pack, in bytes: a longer document has a pack of its own.
PACK_BYTES = 8 << 20
#: No UTF-8 text holds this byte; it stands for the end of a document.
END = b"\xff"
#: What packs ask at each level: occurrences of grams, symbols after contexts, gains of contexts.
SEEN, KINDS, GAINS = range(3)
_ANSWER = "struct<topic:int,share:bigint,answer:binary>"


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of a context's key and the next word's."""
    h = context * np.uint64(0x9E3779B97F4A7C15)
    h += word
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _tokens_blob(ids: list, texts: list) -> bytes:
    """doc_id and number of tokens per document, word hashes in ascending order, and each token's place among them."""
    import xxhash

    words = (b" ".join(part for text in texts for part in (text, END))).lower().split()
    seen: dict[bytes, int] = {}
    first = np.fromiter(map(seen.setdefault, words, itertools.count()), np.int64, len(words))
    ends = np.flatnonzero(first == seen[END])
    hashes = np.fromiter((xxhash.xxh64_intdigest(b"" if w == END else w) for w in seen), np.uint64, len(seen))
    vocabulary, place = np.unique(hashes, return_inverse=True)
    number = np.empty(len(words), np.int32)
    number[np.fromiter(seen.values(), np.int64, len(seen))] = place
    documents = pa.array([{"doc_id": i, "size": s} for i, s in zip(ids, np.diff(ends, prepend=-1).tolist())], pa.struct([("doc_id", pa.int64()), ("size", pa.int64())]))
    lists = [documents, pa.array(vocabulary), pa.array(number[first])]
    return to_blob(pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for name, v in zip(("documents", "words", "tokens"), lists)}))


def _packs(batches):
    # A pack's number holds its task and its place within it.
    gid, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
            if ids and held + len(text) > PACK_BYTES:
                yield pa.RecordBatch.from_pydict({"gid": [gid], "body": [_tokens_blob(ids, texts)]})
                gid, ids, texts, held = gid + 1, [], [], 0
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
    if ids:
        yield pa.RecordBatch.from_pydict({"gid": [gid], "body": [_tokens_blob(ids, texts)]})


class Tokens:
    """The tokens of one pack: places among its words, which of them teach, and which another of their document follows."""

    def __init__(self, blob: bytes) -> None:
        table = from_blob(blob)
        lists = {name: table.column(name).combine_chunks().flatten() for name in table.column_names}
        self.ids, self.sizes = lists["documents"].field("doc_id").to_pylist(), lists["documents"].field("size").to_numpy()
        self.words, self.tokens = lists["words"].to_numpy(), lists["tokens"].to_numpy()
        self.first = np.cumsum(self.sizes) - self.sizes
        self.goes_on = np.ones(len(self.tokens), bool)
        self.goes_on[self.first + self.sizes - 1] = False
        self.held_out = crc_rest(self.ids, MODULUS) == HELD_OUT
        self.teaches = np.repeat(~self.held_out, self.sizes)


class Walk:
    """How far the answers carry one pack: probabilities by the longest states known, and what to ask next.

    Of each level only the places of its grams are held, as 32-bit numbers: a pack's tokens are many.
    """

    def __init__(self, tokens: Tokens, answers: dict[int, np.ndarray], unknown: float | None) -> None:
        self.asks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.chance = None
        grams, which = tokens.words, tokens.tokens
        if SEEN not in answers:
            self.asks[SEEN] = grams, np.bincount(which, tokens.teaches, len(grams))
            return
        seen, _ = _seen(answers[SEEN])
        self.counts = seen
        self.chance = ((seen + 1) * unknown)[which]
        at, settled = np.arange(len(which), dtype=which.dtype), True
        for level in range(1, DEPTH + 1):
            # Grams of one word more end where the gram before is a candidate.
            more = (seen >= LEAST_SEEN)[which] & tokens.goes_on[at]
            context, at = which[more], at[more] + 1
            found, example, number = distinct(_mix(grams[context], tokens.words[tokens.tokens[at]]))
            contexts, _, context = distinct(context[example])
            names, total = grams[contexts], seen[contexts]
            asked = 3 * level
            if not len(found):
                return
            if asked + SEEN not in answers:
                self.asks[asked + SEEN] = found, np.bincount(number, tokens.teaches[at], len(found))
                return
            seen, first = _seen(answers[asked + SEEN])
            if asked + KINDS not in answers:
                self.asks[asked + KINDS] = names, np.bincount(context, first, len(names))
                settled = False
            elif settled:
                kinds = answers[asked + KINDS]
                before = self.chance[at[example]]
                chance = (seen + kinds[context] * before) / (total + kinds)[context]
                if asked + GAINS not in answers:
                    own = np.bincount(number, tokens.teaches[at], len(found))
                    # This pack's part of the gain, less what its kinds have to gain: the parts of all packs add up.
                    self.asks[asked + GAINS] = names, np.bincount(context, own * np.log(chance / before) - LEAST_GAIN * first, len(names))
                    settled = False
                else:
                    retained = (answers[asked + GAINS] > 0)[context]
                    kept = retained[number]
                    self.chance[at[kept]] = chance[number[kept]]
            grams, which = found, number


def _seen(answer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training occurrences, and whether this pack is the one that counts the gram as a kind."""
    times = np.floor(answer / 2)
    return times, answer - 2 * times


def _combine(topic: int, which: np.ndarray, values: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """Sums per key; those of occurrences doubled, plus 1 for the first pack whose training documents hold the key.

    Of gains only whether they suffice is answered, as sums of logarithms hardly compress.
    """
    if topic % 3 == GAINS:
        return (np.bincount(which, values) > 0)[which].astype(np.float64)
    sums = np.bincount(which, values)[which]
    if topic % 3 != SEEN:
        return sums
    # Of what is written to one place the last stays: going backwards, the first pack.
    teaching = np.flatnonzero(values > 0)[::-1]
    first = np.full(which.max() + 1, -1)
    first[which[teaching]] = teaching
    sums *= 2
    sums[first[first >= 0]] += 1
    return sums


def _walks(batches, unknown: float | None):
    for batch in batches:
        for i in range(batch.num_rows):
            tokens = Tokens(batch.column("body")[i].as_py())
            yield batch.column("gid")[i].as_py(), tokens, Walk(tokens, read_answers(batch.column("answers")[i].as_py(), np.float64), unknown)
            # One pack is held at a time; who reads the walks lets go of each as well.
            del tokens


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts have one token, the end. A null id counts as the empty text for its remainder. Repeated rows
    teach as often as they appear and are scored each. Without training documents all tokens are unknown and both
    scores are 0, the log of 1 over V + 1 = 1. Other columns are not looked at; an empty table gives an empty one.
    """
    docs = ids_and_text(docs)
    size = text_size(docs)
    bits = share_bits(size // PACK_BYTES + 1)
    packs = in_buckets(docs.mapInArrow(_packs, "gid long, body binary"), size // (2 * PACK_BYTES))
    answers, unknown, train_tokens = None, None, 0

    def met() -> DataFrame:
        return packs.withColumn("answers", F.lit(None).cast(f"array<{_ANSWER}>")) if answers is None else packs.join(gathered(answers, packs), "gid", "left")

    # Occurrences of a level are asked one step before its kinds, those one before its gains.
    for _ in range(DEPTH + 3):
        chance = unknown

        def ask(batches):
            for gid, _, walk in _walks(batches, chance):
                for topic, (keys, values) in walk.asks.items():
                    yield from blocks(gid, topic, keys, values, bits)
                walk = keys = values = None

        found = answered(met().mapInArrow(ask, ASKS), bits, np.float64, _combine)
        if answers is None:
            total = found.mapInArrow(_totals, "tokens double, kinds double").agg(F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0.0)).alias("v")).first()
            unknown, train_tokens = 1.0 / (total.n + total.v + 1), int(total.n)
        answers = found if answers is None else answers.unionAll(found)

    def rate(batches):
        for _, tokens, walk in _walks(batches, unknown):
            known, base = walk.counts > 0, np.log10((walk.counts + 1) * unknown)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(tokens.ids, pa.int64()), "held_out": pa.array(tokens.held_out), "n_tokens": pa.array(tokens.sizes),
                "n_known": np.add.reduceat(known[tokens.tokens], tokens.first, dtype=np.int64),
                "train_tokens": pa.array([train_tokens] * len(tokens.ids), pa.int64()),
                "base_score": np.add.reduceat(base[tokens.tokens], tokens.first),
                "score": np.add.reduceat(np.log10(walk.chance), tokens.first)})
            tokens = walk = None

    return met().mapInArrow(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _totals(batches):
    """Training tokens and different ones: every word is counted where it is a kind."""
    for batch in batches:
        for blob in batch.column("answer").to_pylist():
            times, first = _seen(expand(blob, np.float64))
            yield pa.RecordBatch.from_pydict({"tokens": [float(times @ first)], "kinds": [float(first.sum())]})
