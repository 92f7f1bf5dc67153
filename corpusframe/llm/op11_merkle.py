"""A Merkle manifest of the documents, climbed by a recursive query.

Documents become leaves, the leaves of a language a tree whose runs of eight nodes share a parent, and the subroots
of the languages one more tree. Every built level is a stored table of node rows that hold their children's digests
and the way to their own parent. A recursive query starts at every leaf with the digest of what may be a tampered
text and ascends: at each step it meets the parent, appends a row with the siblings it finds there and folds its
digest with them. What arrives at the top is the root that this leaf vouches for.

All leaves meet again at the root, and a third of them in one subroot, so a node is stored once per FAN_IN leaves
below it, and a climber meets the copy its own number names: no key of the join has more than FAN_IN climbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import crc_bucket, settle, stored

#: Consecutive nodes that have one parent.
ARITY = 8
#: Leaves that meet one copy of a node.
FAN_IN = 4096
#: Trees whose subroots may travel to all tasks (about 100 bytes each).
BROADCAST_TREES = 50_000
#: Every third crc32 of an id marks a document as tampered with.
TAMPERED = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The number of the tree over all subroots.
TOP = -1


def _part(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _raw(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", tree_column: str = "lang", text_column: str = "text") -> DataFrame:
    """doc_id, lang, leaf and seen (the leaf as found now; of a tampered document another one), digests as bytes."""
    whole = F.concat(*[_part(F.col(f)) for f in fields])
    found = F.concat(*[_part(F.translate(f, UPPER, LOWER) if f == text_column else F.col(f)) for f in fields])
    return docs.select(
        F.col(id_column).alias("doc_id"), F.col(tree_column).cast("string").alias("lang"), _raw(whole).alias("leaf"),
        F.when(crc_bucket(id_column, TAMPERED) == 0, _raw(found)).otherwise(_raw(whole)).alias("seen"))


def in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in ranges of ``order``, settled; _part names the range and _inside counts its rows from 0."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # A range's number and the place in it, as the rows leave their sort.
    placed = ranged.withColumn("_place", F.monotonically_increasing_id())
    return settle(placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_inside", F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place"))


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``name``: place among the rows of a key (a null key is one too), from 0. Only counts per range meet in one task."""
    ranged = in_order(rows, [F.col(key).asc_nulls_first(), *order])
    counts = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.min("_inside").alias("_first"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_key", "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    near = ranged.join(shift, (F.col("_part") == F.col("_range")) & F.col(key).eqNullSafe(F.col("_key")))
    return near.withColumn(name, F.col("_inside") + F.col("_shift")).drop("_part", "_inside", "_key", "_range", "_shift")


def _above(nodes: DataFrame) -> DataFrame:
    """The next level from rows (tree, pos, digest, below): children joined in order as one string of bytes."""
    runs = nodes.groupBy("tree", F.floor(F.col("pos") / ARITY).alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("kids"), F.sum("below").alias("below"))
    text = F.array_join(F.transform("kids", lambda k: F.lower(F.hex(k["digest"]))), "")
    return runs.select("tree", "pos", _raw(text).alias("digest"), "below", F.unhex(text).alias("kids"))


def _levels(base: DataFrame, sizes: DataFrame, height: int) -> list[DataFrame]:
    """Levels 1 to ``height`` of all trees; a tree ends where one node is left. sizes: tree, size."""
    out, level = [], base
    for n in range(height):
        going = sizes.where(F.col("size") > ARITY**n).select("tree")
        level = stored(_above(level.select("tree", "pos", "digest", "below").join(going, "tree", "left_semi")))
        out.append(level.withColumn("level", F.lit(n + 1)))
    return out


def _height(size: int) -> int:
    height = 0
    while ARITY**height < size:
        height += 1
    return height


def manifest(docs: DataFrame, id_column: str = "doc_id", tree_column: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """leaves (row, doc_id, leaf, seen, tree and the way up), nodes (inner nodes and their way up), trees (tree, subroot, root).

    The way up: up_tree, up_level, up_pos name the parent, slot is the place among its children; null at the root.
    """
    rows = numbered(leaves(docs, id_column=id_column, tree_column=tree_column), "lang", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "pos")
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    trees = stored(numbered(langs.withColumn("_all", F.lit(0)), "_all", [F.col("lang").asc_nulls_first()], "tree").drop("_all"))
    known = trees.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).first()
    few = known.n <= BROADCAST_TREES
    numbers = trees.select(F.col("lang").alias("_lang"), "tree", "size")
    rows = rows.join(F.broadcast(numbers) if few else numbers, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang", "lang")
    # A row's own number, to gather what its climb appends.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    base = rows.select("tree", "pos", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("below"))
    levels = _levels(base, trees.select("tree", "size"), _height(known.size or 0))
    tops = [base.join(trees.where("size = 1"), "tree", "left_semi").select("tree", "digest", "below")]
    for n, level in enumerate(levels, 1):
        tops.append(level.join(trees.where((F.col("size") > ARITY ** (n - 1)) & (F.col("size") <= ARITY**n)), "tree", "left_semi").select("tree", "digest", "below"))
    subroots = stored(reduce(DataFrame.unionAll, tops))
    top_sizes = trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(known.n).alias("size")).limit(1)
    top_base = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", "below")
    top_levels = _levels(top_base, top_sizes, _height(known.n))
    last = top_levels[-1].select("digest") if top_levels else top_base.select("digest")
    trees = subroots.select("tree", F.col("digest").alias("subroot")).crossJoin(F.broadcast(last.withColumnRenamed("digest", "root"))) if known.n else subroots.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def linked(nodes: DataFrame) -> DataFrame:
        """Nodes below the top of a tree go on inside it; a subroot goes on in the tree over all."""
        inside = F.col("size") > F.pow(F.lit(float(ARITY)), "level")
        over = (F.col("tree") != TOP) & F.lit(known.n > 1)
        return nodes.select(
            *[c for c in nodes.columns if c != "size"],
            F.when(inside, F.col("tree")).when(over, F.lit(TOP).cast("long")).alias("up_tree"),
            F.when(inside, F.col("level") + 1).when(over, 1).cast("int").alias("up_level"),
            F.floor(F.when(inside, F.col("pos")).when(over, F.col("tree")) / ARITY).alias("up_pos"),
            F.pmod(F.when(inside, F.col("pos")).when(over, F.col("tree")), F.lit(ARITY)).cast("int").alias("slot"))

    sizes = numbers.select("tree", "size").unionByName(top_sizes)
    sizes = F.broadcast(sizes) if few else sizes
    inner = [level.select("tree", "pos", "level", "kids", "below") for level in [*levels, *top_levels]]
    empty = base.limit(0).select("tree", "pos", F.lit(1).alias("level"), F.col("digest").alias("kids"), "below")
    nodes = linked(reduce(DataFrame.unionAll, inner, empty).join(sizes, "tree"))
    return linked(rows.withColumn("level", F.lit(0))), nodes, trees


CLIMB = f"""
WITH RECURSIVE climb (row, step, folded, siblings, up_tree, up_level, up_pos, slot, copy) AS (
  SELECT row, 0, seen, cast('' AS binary), up_tree, up_level, up_pos, slot, up_copies FROM {{leaves}}
  UNION ALL
  SELECT c.row, c.step + 1,
         unhex(sha2(lower(hex(concat(substring(n.kids, 1, 32 * c.slot), c.folded, substring(n.kids, 32 * c.slot + 33)))), 256)),
         concat(substring(n.kids, 1, 32 * c.slot), substring(n.kids, 32 * c.slot + 33)),
         n.up_tree, n.up_level, n.up_pos, n.slot, n.up_copies
  FROM climb c JOIN {{nodes}} n
    ON n.tree = c.up_tree AND n.level = c.up_level AND n.pos = c.up_pos AND n.copy = pmod(c.row, c.copy)
)
SELECT row, step, folded, siblings FROM climb LIMIT ALL
"""


def climbed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """row, folded and proof_sha256 of every leaf, by the recursive query."""
    # Every row names the number of copies of its parent, so a climber knows which of them to meet.
    copies = F.greatest(F.lit(1), F.ceil(F.col("below") / FAN_IN)).cast("long")
    counted = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"), copies.alias("up_copies"))
    way = ["up_tree", "up_level", "up_pos"]
    nodes = stored(nodes.join(counted, way, "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))))
    # A leaf's parent stands over at most eight leaves, unless the leaf is a tree of its own.
    alone = counted.where((F.col("up_tree") == TOP) & (F.col("up_copies") > 1))
    start = stored(rows.join(alone, way, "left").withColumn("up_copies", F.coalesce("up_copies", F.lit(1).cast("long"))))
    spark = rows.sparkSession
    steps = spark.sql(CLIMB, leaves=start, nodes=nodes)
    proof = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "siblings"))), lambda s: F.lower(F.hex(s["siblings"]))), "")
    return steps.groupBy("row").agg(F.max_by("folded", "step").alias("folded"), F.sha2(proof, 256).alias("proof_sha256"))


def verify(docs: DataFrame, id_column: str = "doc_id", tree_column: str = "lang") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, digests as lowercase hex.

    A null id comes first in its language and counts as the empty text for tampering; a null language is a tree of its
    own, before all others. Rows with one id stand in the order of their leaves, so repeated rows are interchangeable
    leaves, each with its own proof. Null, empty and long fields are leaves as any other; other columns are not read.
    An empty table has no rows.
    """
    rows, nodes, trees = manifest(docs, id_column, tree_column)
    found = rows.select("row", "doc_id", "leaf", "tree").join(climbed(rows, nodes), "row")
    trees = F.broadcast(trees) if trees.count() <= BROADCAST_TREES else trees
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")}
    return found.join(trees, "tree").select(
        "doc_id", *[v.alias(c) for c, v in text.items()], "proof_sha256",
        F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


_HASHED = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in FIELDS)
_FOUND = _HASHED.replace("text::varchar", f"translate(text, '{UPPER}', '{LOWER}')")
# 3988292384 is the polynomial of crc32, reflected.
_CRC = """xor(4294967295::ubigint, list_reduce(list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda d: coalesce(ascii(d), 0)::ubigint),
    lambda c, b: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384::ubigint * (r & 1)), xor(c, b)), 4294967295::ubigint))"""
SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, sha256({_HASHED}) AS leaf,
    CASE WHEN (CASE WHEN doc_id IS NULL THEN 0 ELSE {_CRC} END) % 3 = 0 THEN sha256({_FOUND}) ELSE sha256({_HASHED}) END AS seen
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM leaf
), tree(t, level, pos, n, digest, kids) AS (
  SELECT t, 0, pos, n, leaf, NULL::varchar[] FROM placed
  UNION ALL
  SELECT t, level + 1, pos // 8, any_value(n), sha256(string_agg(digest, '' ORDER BY pos)), list(digest ORDER BY pos)
  FROM tree WHERE n > 8 ** level GROUP BY t, level, pos // 8
), subroots AS (
  SELECT t, digest, count(*) OVER () AS n, level AS height FROM tree WHERE n <= 8 ** level
), top(level, pos, n, digest, kids) AS (
  SELECT 0, t, n, digest, NULL::varchar[] FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, any_value(n), sha256(string_agg(digest, '' ORDER BY pos)), list(digest ORDER BY pos)
  FROM top WHERE n > 8 ** level GROUP BY level, pos // 8
), nodes AS (
  SELECT t, level, pos, kids FROM tree WHERE level > 0
  UNION ALL SELECT -1, level, pos, kids FROM top WHERE level > 0
), climb(doc_id, leaf, own, place, t, level, pos, slot, folded, proof) AS (
  SELECT doc_id, leaf, t, pos, t, 1, pos // 8, pos % 8, seen, '' FROM placed WHERE n > 1
  UNION ALL
  SELECT doc_id, leaf, t, pos, -1, 1, t // 8, t % 8, seen, '' FROM placed WHERE n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own, c.place,
    CASE WHEN c.t >= 0 AND s.height = c.level THEN -1 ELSE c.t END,
    CASE WHEN c.t >= 0 AND s.height = c.level THEN 1 ELSE c.level + 1 END,
    CASE WHEN c.t >= 0 AND s.height = c.level THEN c.own // 8 ELSE c.pos // 8 END,
    CASE WHEN c.t >= 0 AND s.height = c.level THEN c.own % 8 ELSE c.pos % 8 END,
    sha256(array_to_string(list_concat(k.kids[1:c.slot], [c.folded], k.kids[c.slot + 2:]), '')),
    c.proof || array_to_string(list_concat(k.kids[1:c.slot], k.kids[c.slot + 2:]), '')
  FROM climb c JOIN subroots s ON s.t = c.own JOIN nodes k ON k.t = c.t AND k.level = c.level AND k.pos = c.pos
), arrived AS (
  SELECT own, place, doc_id, leaf, arg_max(folded, length(proof)) AS folded, arg_max(proof, length(proof)) AS proof FROM climb GROUP BY ALL
)
SELECT a.doc_id, a.leaf, s.digest AS subroot, r.digest AS root, sha256(a.proof) AS proof_sha256, a.folded AS folded_root, a.folded = r.digest AS verified
FROM arrived a JOIN subroots s ON s.t = a.own, (SELECT digest FROM top WHERE n <= 8 ** level) r
"""
