import random
import time

import pytest
from pyspark.sql import functions as F

from corpusframe.config import Config
from corpusframe.operators import ingest, structure
from corpusframe.sources import tables
from corpusframe.streaming import jobs

PAGE = """# Title with **bold** word

Intro line one
still intro

## Leave ##
- first item
- second item
    - nested
1. third

```python
# not a heading

x = 1
~~~
```
Underlined
==========
text after

| A | B |
|---|:-:|
| 1 | `two` |

> quoted
> more

---

end ﷐x [link](http://u) #tag
- not a list"""


def blocks(df, reader=ingest.blocks_from_markdown):
    return [(r.document_id, r.pos, r.heading_level, r.text) for r in reader(df).orderBy("document_id", "pos").collect()]


def test_markdown(frame):
    docs = frame("document_id string, content string", [("a", PAGE), ("b", None), ("c", " \n\n"), ("d", "```\nnever closed\n\nx"), ("e", "~~~\na\n```\n~~~\n~~~~ x\nb\n~~~\nc\n~~~~")])
    got = blocks(docs)
    assert [row[2:] for row in got if row[0] == "a"] == [
        (1, "Title with\nbold\nword"), (None, "Intro line one\nstill intro"), (2, "Leave"), (None, "first item"),
        (None, "second item\nnested"), (None, "third"), (None, "# not a heading\n\nx = 1\n~~~"), (1, "Underlined"),
        (None, "text after"), (None, "A\n\nB\n\n1\n\ntwo"), (None, "quoted\nmore"), (None, "end ﷐x\nlink\n#tag\n- not a list")]
    assert [row[1] for row in got if row[0] == "a"] == list(range(12))
    assert [row[3] for row in got if row[0] in "bcd"] == ["```\nnever closed", "x"]
    # A fence closes by its own mark, as long as it opened.
    assert [row[3] for row in got if row[0] == "e"] == ["a\n```", "b\n~~~\nc"]


def test_text_keeps_every_character(frame):
    docs = frame("document_id string, content string", [("a", "Intro\nline﷐ two﷑\n\n1. Leave\ntext\n\n\nx\nALL CAPS\n"), ("b", None), ("c", "\n")])
    assert blocks(docs, ingest.blocks_from_text) == [
        ("a", 0, None, "Intro\nline﷐ two﷑"), ("a", 1, 2, "1. Leave"), ("a", 2, None, "text"), ("a", 3, None, "x"), ("a", 4, 1, "ALL CAPS")]


def test_readers_by_type_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    body = "Staff may take twenty two days of leave in a year."
    (source / "a.txt").write_text(f"1. Leave\n{body} txt\n")
    (source / "b.md").write_text(f"# Policy\n\n## Leave\n\n{body} md\n\n```\n# code\n```\n")
    (source / "c.html").write_text(f"<h1>Policy</h1><h2>Leave</h2><p>{body} html</p><p>{body} again</p>")
    files = tables.read_files(spark, str(source))
    chunks = jobs.ingest_batch(files, Config(allowed_types=("text/plain", "text/markdown", "text/html")))
    got = {(r.filename, r.section_path, r.content.split()[-1]) for r in chunks.collect()}
    assert got == {
        ("a.txt", "1. Leave", "txt"), ("b.md", "Policy > Leave", "code"), ("c.html", "Policy > Leave", "again")}


def test_stack_of_any_depth(frame):
    rng = random.Random(3)
    rows, want = [], {}
    for n in range(40):
        stack = []
        for pos in range(rng.randint(1, 60)):
            level = rng.choice([1, 2, 12, 25, 40, 1000])
            rows.append((f"d{n}", pos, f"t{pos}", None, level))
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = stack[-1][1] if stack else None
            stack.append((level, pos + 1))
            want[f"d{n}", pos + 1] = (parent and f"s{parent}", len(stack))
    df = frame("document_id string, pos int, text string, page_number int, heading_level int", rows)
    tree = structure.section_tree(df.withColumn("path", F.lit(1)).drop("path"))
    assert {(r.document_id, r.section_no): (r.parent_section_id, len(r.path)) for r in tree.collect()} == want


@pytest.mark.parametrize("reader", [ingest.blocks_from_text, ingest.blocks_from_markdown])
def test_long_documents_take_time_by_their_lines(frame, reader):
    """The cuts between groups are worked out once per document, not once for each of its groups."""
    text = "\n\n".join(f"the {i}th paragraph, in two\nlines." for i in range(6000))
    began = time.perf_counter()
    rows = reader(frame("document_id int, content string", [(1, text)])).agg(F.count("*").alias("n"), F.max("pos").alias("last")).first()
    assert rows["n"] == 6000 and rows["last"] == 5999
    assert time.perf_counter() - began < 30
