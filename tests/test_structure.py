import random

import pyarrow as pa
from pyspark.sql import functions as F

from corpusframe.config import Config
from corpusframe.operators import chunking, ingest, scale, structure


def blocks(frame, rows, doc="d"):
    """rows: (text, level, page)."""
    return frame("document_id string, pos int, text string, page_number int, heading_level int",
                 [(doc, i, t, p, level) for i, (t, level, p) in enumerate(rows)])


def test_nesting_siblings_and_paths(frame):
    tree = structure.section_tree(blocks(frame, [
        ("HR Policy", 1, None), ("1. Leave", 2, None), ("1.1 Annual", 3, None), ("text", None, None), ("2. Pay", 2, None)]))
    got = [(r.section_id, r.parent_section_id, " > ".join(r.path)) for r in tree.orderBy("section_no").collect()]
    assert got == [
        ("s1", None, "HR Policy"), ("s2", "s1", "HR Policy > 1. Leave"),
        ("s3", "s2", "HR Policy > 1. Leave > 1.1 Annual"), ("s4", "s1", "HR Policy > 2. Pay")]


def test_preamble_is_a_parent_and_headings_without_text_stay(frame):
    source = blocks(frame, [("intro", None, 2), ("Deep", 2, None), ("body", None, 5), ("Empty", 1, None)])
    tree = structure.section_tree(source).orderBy("section_no").collect()
    assert [(r.title, r.level, r.parent_section_id) for r in tree] == [("Preamble", 1, None), ("Deep", 2, "s1"), ("Empty", 1, None)]
    assert [r.section_id for r in structure.content_sections(structure.section_tree(source), source).orderBy("section_no").collect()] == ["s1", "s2"]
    texts = {r.section_no: (r.text, r.page_start, r.page_end) for r in structure.section_text(source).collect()}
    assert texts == {1: ("intro", 2, 2), 2: ("body", 5, 5)}
    assert structure.section_outline(structure.section_tree(source)).first().outline == "- [s1] Preamble\n  - [s2] Deep\n- [s3] Empty"


def test_windows_equal_a_stack(frame):
    rng = random.Random(7)
    rows, want = [], {}
    for n in range(200):
        doc, stack, sections, pos = f"d{n}", [], [], 0
        for pos in range(rng.randint(1, 14)):
            level = rng.choice([None, 1, 2, 3, 4, 7])
            rows.append((doc, pos, f"t{pos}", None, level))
            if level is None and not stack:
                stack.append((1, len(sections) + 1, None))
                sections.append((None, [1]))
            if level is not None:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                parent = stack[-1][1] if stack else None
                stack.append((level, len(sections) + 1, parent))
                sections.append((parent, [s[1] for s in stack]))
        want[doc] = [p for p, _ in sections]
        want[doc + "/path"] = [len(path) for _, path in sections]
    tree = structure.section_tree(frame(
        "document_id string, pos int, text string, page_number int, heading_level int", rows)).orderBy("section_no").collect()
    got = {}
    for r in tree:
        got.setdefault(r.document_id, []).append(int(r.parent_section_id[1:]) if r.parent_section_id else None)
        got.setdefault(r.document_id + "/path", []).append(len(r.path))
    assert got == {k: v for k, v in want.items() if v}


def test_text_blocks(frame):
    docs = frame("document_id string, content string", [("d", "Leave Rules\nline one.\nline two.\n\n\nnext para.\n1.2 Annual\n"), ("e", " \n")])
    got = [(r.pos, r.text, r.heading_level) for r in ingest.blocks_from_text(docs).orderBy("pos").collect()]
    assert got == [(0, "Leave Rules", 1), (1, "line one.\nline two.", None), (2, "next para.", None), (3, "1.2 Annual", 3)]


def test_html_walk(frame):
    page = ("<h1>Top</h1><p>one <b>two</b></p><ul><li>a<p>inner</p></li><li></li></ul>"
            "<table><tr><td>x</td></tr></table><script>no()</script><h3>Sub &amp; more</h3><p>open<br>end")
    got = [(r.text, r.heading_level) for r in ingest.blocks_from_html(frame("page_id long, html string", [(1, page)])).orderBy("pos").collect()]
    assert got == [("Top", 1), ("one\ntwo", None), ("a\ninner", None), ("x", None), ("Sub & more", 3), ("open\nend", None)]
    native = ingest.html_headings(frame("page_id long, html string", [(1, page)])).orderBy("pos").collect()
    assert [(r.heading_level, r.title) for r in native] == [(1, "Top"), (3, "Sub &amp; more")]


def test_splitter_rules():
    split = chunking.split_text
    assert split("abc", 10, 2) == [(0, "abc")]
    assert split("aaaa bbbb cccc", 9, 0) == [(0, "aaaa bbbb"), (10, "cccc")]
    # An overlap repeats whole pieces only, up to its size.
    assert split("aa bb cc dd", 6, 3) == [(0, "aa bb"), (3, "bb cc"), (6, "cc dd")]
    # Paragraphs stay together before lines, lines before words.
    assert split("one two\n\nthree four", 12, 0) == [(0, "one two"), (9, "three four")]
    assert split("x" * 25, 10, 0) == [(0, "x" * 10), (10, "x" * 10), (20, "x" * 5)]
    assert split("  \n\n ", 4, 1) == []


def test_splitter_covers_random_texts():
    rng = random.Random(3)
    for _ in range(200):
        body = "".join(rng.choice(["ab", "c", " ", ". ", "\n", "\n\n", "word"]) for _ in range(rng.randint(1, 80)))
        pieces = chunking.split_text(body, 20, 6)
        assert all(len(p) <= 20 and body[s:s + len(p)] == p and p == p.strip() for s, p in pieces)
        # Without overlap every visible character appears once, in order.
        once = "".join(p for _, p in chunking.split_text(body, 20, 0))
        assert "".join(once.split()) == "".join(body.split())


def test_chunks_cite_the_page_they_start_on(frame):
    source = blocks(frame, [("4. Leave", 1, 4)] + [(ch * 700, None, p) for ch, p in zip("abcd", (4, 5, 6, 7))])
    sections = structure.section_text(source)
    chunks = chunking.chunk_sections(sections, config=Config(chunk_size=750, chunk_overlap=0))
    pages = chunking.chunk_pages(chunks, chunking.block_spans(structure.section_blocks(source)))
    assert [r.page_number for r in pages.orderBy("chunk_index").collect()] == [4, 5, 6, 7]


def test_page_of_offsets(frame):
    spans = frame("document_id string, section_no int, start int, end int, page_number int", [
        ("a", 1, 0, 10, 1), ("a", 1, 12, 20, 2), ("b", 1, 0, 10, None), ("b", 1, 12, 20, 3), ("c", 1, 0, 5, None)])
    chunks = frame("document_id string, section_no int, chunk_index int, start int", [
        ("a", 1, 0, 0), ("a", 1, 1, 11), ("a", 1, 2, 15), ("a", 1, 3, 30), ("b", 1, 0, 5), ("b", 1, 1, 11), ("c", 1, 0, 2)])
    got = {(r.document_id, r.chunk_index): r.page_number for r in chunking.chunk_pages(chunks, spans).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 2): 2, ("a", 3): 2, ("b", 0): 3, ("b", 1): 3, ("c", 0): None}


def test_summary_windows_reach_the_tail(frame):
    body = "".join(f"block{i:03d}".ljust(1000, ".") for i in range(100))
    config = Config(summary_window=1000, summary_parts=5)
    parts = chunking.summary_windows(frame("document_id string, content string", [("d", body), ("e", "short"), ("f", "y" * 2500)]), config=config)
    by_doc = {}
    for r in parts.orderBy("part").collect():
        by_doc.setdefault(r.document_id, []).append(r.window_text)
    assert len(by_doc["d"]) == 5 and "block099" in by_doc["d"][-1] and by_doc["d"][0].startswith("block000")
    assert by_doc["e"] == ["short"] and [len(w) for w in by_doc["f"]] == [1000, 1000, 500]
    one = chunking.summary_windows(frame("document_id string, content string", [("d", body)]), config=Config(summary_window=1000, summary_parts=1))
    assert [r.start for r in one.collect()] == [0]


def test_decode_blocks_falls_back(frame):
    docs = frame("document_id string, blocks string, content string", [
        ("a", '[{"text":"T","page_number":2,"heading_level":1},{"text":"b"}]', "x"), ("b", "{oops", "whole"), ("c", None, "whole"), ("d", "[]", "whole")])
    got = [(r.document_id, r.pos, r.text, r.page_number, r.heading_level)
           for r in ingest.decode_blocks(docs, "document_id", "blocks", "content").orderBy("document_id", "pos").collect()]
    assert got == [("a", 0, "T", 2, 1), ("a", 1, "b", None, None)] + [(d, 0, "whole", None, None) for d in "bcd"]


def test_counts_structure_and_replacement(frame):
    docs = frame("document_id string, content string", [("a", "abc"), ("z", None)])
    chunks = frame("document_id string, chunk_id string", [("a", "a:0"), ("a", "a:1"), (None, "x")])
    assert {r.document_id: r.chunk_count for r in chunking.chunk_counts(docs, chunks).collect()} == {"a": 2, "z": 0}
    shape = {r.document_id: r for r in chunking.document_structure(docs, blocks(frame, [("H", 1, 1), ("t", None, 3)], "a"), chunks).collect()}
    assert shape["a"].page_count == 3 and shape["a"].structure_available and [s.title for s in shape["a"].sections] == ["H"]
    assert not shape["z"].structure_available and shape["z"].sections == [] and shape["z"].character_count == 0
    new = frame("document_id string, chunk_id string", [("a", "a:0")])
    assert sorted(r.chunk_id for r in chunking.replace_chunks(chunks.where("document_id is not null"), new).collect()) == ["a:0"]


def test_gates_and_dedup(frame):
    files = frame("name string, mime string, size long, head binary", [
        ("ok.txt", "text/plain", 10, b"abc"), ("ok.pdf", "application/pdf", 10, b"%PDF-1.7"), ("bad.pdf", "application/pdf", 10, b"abc"),
        ("big.txt", "text/plain", 5 * 1024 * 1024 + 1, b"a"), ("no.size", "text/plain", None, b"a"), ("x.exe", "application/exe", 1, b"MZ"),
        ("old.doc", "application/msword", 10, bytes.fromhex("d0cf11e0a1b11ae1"))])
    got = {r.name: r.reject_reason for r in ingest.gate_files(files).collect()}
    assert got == {"ok.txt": None, "ok.pdf": None, "bad.pdf": "type_mismatch", "big.txt": "too_large", "no.size": "size_unknown",
                   "x.exe": "type_not_allowed", "old.doc": None}
    batch = files.withColumn("request", F.lit(1))
    assert {r.reject_reason for r in ingest.gate_files(batch, batch="request").collect()} == {"too_many_files"}
    docs = frame("id int, h string", [(1, "x"), (2, "y"), (3, "x"), (4, "x")])
    assert {r.id: r.duplicate_of for r in ingest.dedup_exact(docs, "h", "id").collect()} == {1: None, 2: None, 3: 1, 4: 1}


def test_pages_and_sections_are_read_in_steps(frame, monkeypatch):
    """A batch is worked on in parts of bounded text; rows without text and long ones included."""
    texts = ["<h1>T</h1><p>" + "word " * n + "</p>" for n in (1, 500, 3, 400, 2)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["page_id", "html"])
    monkeypatch.setattr(scale, "STEP_BYTES", 100)
    steps = list(scale.in_steps(iter([batch]), 1))
    assert [s.num_rows for s in steps] == [1, 1, 1, 1, 3]
    assert pa.Table.from_batches(steps).equals(pa.Table.from_batches([batch]))
    parts = list(ingest._walk_html(iter([batch])))
    assert [p.num_rows for p in parts] == [2, 2, 2, 2, 2]


def test_sections_are_read_and_cut_once(spark):
    """What is left to do after the blocks and the chunks have been settled reads no text and cuts none."""
    from corpusframe.plans import catalog

    chunks = catalog.QUERIES["chunk_sections"](spark, "/root/testdata/sf0.001")
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "parquet" not in plan.lower()
    assert chunks.count() > 0
