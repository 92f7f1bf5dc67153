"""The registered queries of the operators; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.session import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_quality(read) -> DataFrame:
    """Quality rules of every document."""
    from corpusframe.llm import op1_quality as quality

    return quality.judge(read("documents"), read("labels"))


@query
def op2_suffix(read) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    from corpusframe.llm import op2_suffix as suffix

    return suffix.report(read("documents"))


@query
def op3_simhash(read) -> DataFrame:
    """Near duplicates among all documents."""
    from corpusframe.llm import op3_simhash as simhash

    return simhash.components(read("documents"))


@query
def op4_bpe(read) -> DataFrame:
    """Byte-level BPE of every document, and back."""
    from corpusframe.llm import op4_bpe as bpe

    return bpe.round_trip(read("documents"), *_vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_pst(read) -> DataFrame:
    """Language-model scores of every document."""
    from corpusframe.llm import op5_pst as pst

    return pst.score(read("documents"))


@query
def op6_ann(read) -> DataFrame:
    """Nearest vectors of every twentieth vector."""
    from corpusframe.llm import op6_ann as ann

    vectors = read("embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op9_langid(read) -> DataFrame:
    """Language of every document."""
    from corpusframe.llm import op9_langid as langid

    return langid.identify(read("documents"))


@query
def op7_toxicity(read) -> DataFrame:
    """Toxicity of every document."""
    from corpusframe.llm import op7_toxicity as toxicity

    return toxicity.rate(read("documents"), read("labels"))


@query
def op8_mixing(read) -> DataFrame:
    """All documents mixed to the weights of their sources."""
    from corpusframe.llm import op8_mixing as mixing

    return mixing.mix(read("documents"))


@query
def op10_html(read) -> DataFrame:
    """Main text of every page."""
    from corpusframe.llm import op10_html as pages

    return pages.extract(read("pages"))


@query
def op11_merkle(read) -> DataFrame:
    """Proof and verdict of every document against the manifest's root."""
    from corpusframe.llm import op11_merkle as merkle

    return merkle.verify(read("documents"))


@query
def op12_license(read) -> DataFrame:
    """License phrases and notices of every document."""
    from corpusframe.llm import op12_license as license

    return license.scan(read("documents")).drop("spans")


@query
def op13_negatives(read) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    from corpusframe.llm import op13_negatives as mining

    return mining.mine(read("embeddings"))


def _sql() -> None:
    from corpusframe.llm import op8_mixing, op11_merkle, op13_negatives

    ORACLES["op8_mixing"] = op8_mixing.SQL
    ORACLES["op11_merkle"] = op11_merkle.SQL
    ORACLES["op13_negatives"] = op13_negatives.SQL


_sql()
