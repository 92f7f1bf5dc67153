import pytest
from pyspark.sql import functions as F

from corpusframe.config import Config
from corpusframe.functions import tabular
from corpusframe.operators import chunking, ingest, structure
from corpusframe.plans import model_tables as m

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["document_id", "section_no", "chunk_index", "chunk_id", "start", "content"]


def listed(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_equals_chunk_sections(spark):
    tabular.register(spark)
    blocks = ingest.blocks_from_text(m.texts(spark, FOLDER), "doc_id", "text").withColumnRenamed("doc_id", "document_id")
    sections = structure.section_text(blocks.withColumn("page_number", F.lit(1))).repartition(5)
    sections.createOrReplaceTempView("sections_of_texts")
    got = spark.sql("SELECT * FROM chunks_of(TABLE(sections_of_texts) PARTITION BY document_id ORDER BY section_no)")
    assert got.columns == COLUMNS
    assert listed(got) == listed(chunking.chunk_sections(sections))
    small = spark.sql("SELECT * FROM chunks_of(size => 300, overlap => 50, sections => TABLE(SELECT *, 1 AS other FROM sections_of_texts) PARTITION BY document_id ORDER BY section_no)")
    assert listed(small) == listed(chunking.chunk_sections(sections, config=Config(chunk_size=300, chunk_overlap=50)))


def test_small_cases(spark, frame):
    tabular.register(spark)
    frame("document_id string, section_no bigint, text string", [("a", 2, "two"), ("a", 1, "one"), ("b", 1, None), ("c", 1, " "), (None, 1, "x")]).createOrReplaceTempView("few_sections")
    got = spark.sql("SELECT document_id, section_no, chunk_index, chunk_id, content FROM chunks_of(TABLE(few_sections) PARTITION BY document_id ORDER BY section_no)").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1, 0, "a:0", "one"), ("a", 2, 1, "a:1", "two"), (None, 1, 0, None, "x")], key=str)
    assert spark.sql("SELECT * FROM chunks_of(TABLE(SELECT * FROM few_sections WHERE false) PARTITION BY document_id ORDER BY section_no)").count() == 0
    with pytest.raises(Exception, match="needs the columns text"):
        spark.sql("SELECT * FROM chunks_of(TABLE(SELECT document_id, section_no FROM few_sections))").collect()
    with pytest.raises(Exception, match="overlap < size"):
        spark.sql("SELECT * FROM chunks_of(TABLE(few_sections), 10, 10)").collect()
    for form in ("WITH SINGLE PARTITION", "PARTITION BY document_id ORDER BY section_no DESC"):
        with pytest.raises(Exception, match="needs PARTITION BY document_id"):
            spark.sql(f"SELECT * FROM chunks_of(TABLE(few_sections) {form})").collect()
