"""Table functions for SQL.

``register(spark)``, then ``SELECT * FROM chunks_of(TABLE(sections) PARTITION BY document_id ORDER BY section_no)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusframe.config import DEFAULT
from corpusframe.operators.chunking import split_text
from corpusframe.session import ship

NEEDED = ["document_id", "section_no", "text"]


class ChunksOf:
    """Chunks of each section, numbered over the whole document as ``chunk_sections`` does.

    The table argument has document_id, section_no and text; other columns are not looked at. It is partitioned by
    document_id and ordered by section_no; a task that sees another document or an earlier section fails rather than
    number wrongly. One section is held at a time. ``size`` and ``overlap`` are constants.
    """

    def __init__(self) -> None:
        self._next, self._document, self._section = 0, None, None

    @staticmethod
    def analyze(sections: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not sections.isTable:
            raise ValueError("chunks_of takes a table: chunks_of(TABLE(sections))")
        kinds = {field.name: field.dataType for field in sections.dataType.fields}
        missing = [name for name in NEEDED if name not in kinds]
        if missing:
            raise ValueError(f"chunks_of needs the columns {', '.join(missing)}")
        width = DEFAULT.chunk_size if size is None else size.value
        shared = DEFAULT.chunk_overlap if overlap is None else overlap.value
        if width is None or shared is None or not 0 <= shared < width:
            raise ValueError("chunks_of needs 0 <= overlap < size, both constant")
        schema = T.StructType([
            T.StructField("document_id", kinds["document_id"]), T.StructField("section_no", kinds["section_no"]),
            T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_id", T.StringType()),
            T.StructField("start", T.IntegerType()), T.StructField("content", T.StringType())])
        return AnalyzeResult(schema)

    def eval(self, sections, size=DEFAULT.chunk_size, overlap=DEFAULT.chunk_overlap):
        doc, number = sections["document_id"], sections["section_no"]
        if self._section is not None and (doc != self._document or number < self._section):
            raise ValueError("chunks_of needs PARTITION BY document_id ORDER BY section_no")
        self._document, self._section = doc, number
        for start, piece in split_text(sections["text"] or "", size, overlap):
            label = f"{doc}:{self._next}"
            yield doc, number, self._next, None if doc is None else label, start, piece
            self._next += 1


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL, here and on the executors."""
    ship(spark)
    spark.udtf.register("chunks_of", udtf(ChunksOf))
