"""Upload gates, two-level duplicate handling, and text to blocks."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.config import DEFAULT, Config
from corpusframe.functions import fixed, text
from corpusframe.operators.scale import in_steps
from corpusframe.session import ship

BLOCK = "array<struct<text:string,page_number:int,heading_level:int>>"


def gate_files(files: DataFrame, config: Config = DEFAULT, batch: str | None = None) -> DataFrame:
    """Add ``reject_reason``, the first gate a file fails, or null.

    files(mime, size, head) where ``head`` is binary; ``batch`` names the upload request.
    """
    if batch is not None:
        sizes = files.groupBy(batch).agg(F.count(F.lit(1)).alias("_files"))
        files = files.join(sizes, batch)
    else:
        files = files.withColumn("_files", F.lit(1))
    magic_ok = F.lit(True)
    for mime, prefix in fixed.MAGIC_BYTES.items():
        magic_ok = F.when(
            F.col("mime") == mime, F.hex(F.substring("head", 1, 8)).startswith(prefix)
        ).otherwise(magic_ok)
    reason = (
        F.when(F.col("_files") > config.max_files, "too_many_files")
        .when(F.col("size").isNull(), "size_unknown")
        .when(F.col("size") > config.max_file_bytes, "too_large")
        .when(~F.coalesce(F.col("mime"), F.lit("")).isin(list(config.allowed_types)), "type_not_allowed")
        .when(~magic_ok, "type_mismatch")
    )
    return files.withColumn("reject_reason", reason).drop("_files")


def ingest_outcomes(
    files: DataFrame, config: Config = DEFAULT, path: str = "path", library: DataFrame | None = None
) -> DataFrame:
    """path, document_id, status, reason and failure_kind of every file.

    accepted; duplicate (reason: the path stored first with the same content, in ``library`` or else in this batch);
    rejected (reason: the gate); failed (no text, or the parser's ``parse_error`` where the files have that column).
    ``library``(document_id, path) holds what earlier batches accepted; a path that it holds itself is not a duplicate.
    """
    error = F.col("parse_error") if "parse_error" in files.columns else F.lit(None)
    gated = gate_files(files, config).select(
        path, "reject_reason", error.cast("string").alias("_error"),
        F.coalesce(text.squash(F.col("content")), F.lit("")).alias("_text"))
    usable = F.col("reject_reason").isNull() & F.col("_error").isNull() & (F.col("_text") != "")
    marked = gated.select(path, "reject_reason", "_error", F.when(usable, F.sha2("_text", 256)).alias("document_id"))
    first = marked.where("document_id is not null").groupBy("document_id").agg(F.min(path).alias("_first"))
    marked = marked.join(first, "document_id", "left")
    if library is not None:
        stored = library.groupBy("document_id").agg(F.min("path").alias("_stored"), F.collect_set("path").alias("_paths"))
        marked = marked.join(stored, "document_id", "left").withColumn("_first", F.when(
            F.array_contains("_paths", F.col(path)), F.col(path)).otherwise(F.coalesce("_stored", "_first")))
    known, again = F.col("document_id").isNotNull(), F.col(path) != F.col("_first")
    return marked.select(
        path, "document_id",
        F.when(F.col("reject_reason").isNotNull(), "rejected").when(~known, "failed")
        .when(again, "duplicate").otherwise("accepted").alias("status"),
        F.coalesce("reject_reason", F.when(~known, F.coalesce("_error", F.lit("no_text"))).when(again, F.col("_first").cast("string"))).alias("reason"),
        F.when(F.col("reject_reason").isNull() & ~known, F.when(F.col("_error").isNull(), "parse").otherwise(
            text.failure(F.lit(""), F.col("_error"))["kind"])).alias("failure_kind"),
    )


def content_hashes(docs: DataFrame, content: str = "content") -> DataFrame:
    return docs.withColumn("sha256", text.file_sha256(F.col(content).cast("binary"))).withColumn(
        "content_sha256", text.content_sha256(F.col(content))
    )


def dedup_exact(docs: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``duplicate_of``: the first row with the same hash, null for the first itself.

    The first is a map-side combined min per hash; joining it back touches only hashes
    that repeat, and a hash shared by a third of the rows is split by the skew join.
    """
    first = (
        docs.groupBy(key)
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
        .drop("_copies")
    )
    marked = docs.join(first, key, "left")
    return marked.withColumn(
        "duplicate_of", F.when(F.col("_first") != F.col(order), F.col("_first"))
    ).drop("_first")


def dedup_against(
    new: DataFrame, library: DataFrame, keys: tuple[str, ...] = ("sha256", "content_sha256")
) -> DataFrame:
    """New rows of which no hash exists in the library."""
    for key in keys:
        new = new.join(library.select(key).distinct(), key, "left_anti")
    return new


def duplicates_report(
    new: DataFrame, library: DataFrame, name: str = "filename",
    keys: tuple[str, ...] = ("sha256", "content_sha256"),
) -> DataFrame:
    """New rows already stored, the hash that matched first, and the stored name."""
    found = new
    for key in keys:
        stored = library.groupBy(key).agg(F.min(name).alias(f"_by_{key}"))
        found = found.join(stored, key, "left")
    matched = F.coalesce(*[F.when(F.col(f"_by_{k}").isNotNull(), F.lit(k)) for k in keys])
    return (
        found.withColumn("matched_on", matched)
        .withColumn("stored_as", F.coalesce(*[F.col(f"_by_{k}") for k in keys]))
        .where("matched_on is not null")
        .drop(*[f"_by_{k}" for k in keys])
    )


def _held(value: Column, use) -> Column:
    """use(value), the value being worked out once: an expression named in a lambda would be worked out at every call of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(lines: Column, starts) -> Column:
    """The array cut before every index that ``starts(line, line before, index)`` accepts; nothing is ever shuffled.

    Whether a line starts a group is decided by itself and the line before it, so the cuts are one filter over the
    indexes and the groups are slices between neighbouring cuts.
    """
    places = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.filter(places, lambda i: starts(F.get(lines, i), F.get(lines, i - 1), i))
    return _held(cuts, lambda cuts: F.transform(
        cuts, lambda cut, at: F.slice(lines, cut + 1, F.coalesce(F.get(cuts, at + 1), F.size(lines)) - cut)))


def _block(value: Column, level: Column) -> Column:
    return F.struct(value.alias("text"), level.cast("int").alias("heading_level"))


def _staged(docs: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """One column after the other, so that each is worked out once per row and only read by those after it."""
    for name, value in columns.items():
        docs = docs.withColumn(name, value)
    return docs.select(*keys, *columns)


def _plain(lines: Column) -> Column:
    """Lines of plain text as structs of the stripped line and its heading level."""
    return F.transform(F.transform(lines, text.strip), lambda line: F.struct(
        line.alias("line"), text.heading_level(line, stripped=True).alias("level")))


def _plain_groups(lines: Column) -> Column:
    def starts(line: Column, before: Column, i: Column) -> Column:
        joined = (i > 0) & (before["line"] != "") & before["level"].isNull() & line["level"].isNull()
        return (line["line"] != "") & ~joined

    return _groups(lines, starts)


def _joined(lines: Column, by: str = "\n") -> Column:
    return F.array_join(F.filter(lines, lambda line: line != ""), by)


def blocks_from_text(docs: DataFrame, doc_id: str = "document_id", content: str = "content") -> DataFrame:
    """Blank lines and headings (guessed from the shape of a line) end a paragraph; any character may stand in the text."""
    staged = _staged(docs, [doc_id], {
        "_lines": _plain(text.lines(F.coalesce(F.col(content), F.lit("")))),
        "_groups": _plain_groups(F.col("_lines")),
    })
    rows = staged.select(doc_id, F.posexplode_outer("_groups").alias("pos", "group")).where("pos is not null")
    level = F.get("group", F.lit(0))["level"]
    body = F.when(level.isNotNull(), F.get("group", F.lit(0))["line"]).otherwise(text.strip(_joined(F.transform("group", lambda g: g["line"]))))
    return rows.select(
        doc_id, "pos", body.alias("text"), F.lit(None).cast("int").alias("page_number"), level.alias("heading_level"))


_FENCE = r"^ {0,3}(`{3,}|~{3,})"
_HEADING = r"^(#{1,6})(.*?)#*\s*$"
_UNDERLINE = r"^(=+|-+) *$"
_ITEM = r"^ {0,3}(?:[*+-]|\d+\.)[ \t]+"
_RULE = r"^ {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$"
_TABLE = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
#: Inline marks and what stands for them: text of its own is a line of its own, as the elements of a page are.
_INLINE = (
    (r"!\[[^\]\n]*\]\([^)\n]*\)", ""), (r"\[([^\]\n]+)\]\([^)\n]*\)", "\n$1\n"), (r"`+([^`\n]+)`+", "\n$1\n"),
    (r"\*\*([^*\n]+)\*\*", "\n$1\n"), (r"__([^_\n]+)__", "\n$1\n"), (r"\*([^*\s][^*\n]*)\*", "\n$1\n"),
    (r"(?<![\p{L}\p{N}_])_([^_\s][^_\n]*)_(?![\p{L}\p{N}_])", "\n$1\n"),
)


def _inline(value: Column) -> Column:
    for pattern, stands in _INLINE:
        value = F.regexp_replace(value, pattern, stands)
    return text.clean_text(value)


def _fences(lines: Column) -> Column:
    """(first, last) line of every fenced part: a fold over the lines that look like fences, with the open one as state.

    A fence closes by the same mark, at least as long, with nothing after it; one that never closes is no fence.
    """
    marks = F.filter(F.transform(lines, lambda line, i: F.struct(
        i.alias("at"), F.regexp_extract(line, _FENCE, 1).alias("mark"),
        F.trim(F.regexp_replace(line, _FENCE, "")).alias("rest"))), lambda m: m["mark"] != "")
    nothing = F.struct(F.lit(-1).alias("at"), F.lit("").alias("mark"), F.lit("").alias("rest"))
    state = F.struct(nothing.alias("open"), F.array().cast("array<struct<first:int,last:int>>").alias("parts"))

    def step(held: Column, mark: Column) -> Column:
        closes = mark["mark"].startswith(held["open"]["mark"]) & (mark["rest"] == "")
        return F.when(held["open"]["mark"] == "", F.struct(mark.alias("open"), held["parts"].alias("parts"))).when(
            closes, F.struct(nothing.alias("open"), F.concat(held["parts"], F.array(F.struct(
                held["open"]["at"].alias("first"), mark["at"].alias("last")))).alias("parts"))).otherwise(held)

    return F.aggregate(marks, state, step)["parts"]


def _markdown_groups(lines: Column) -> Column:
    """Groups of (line, kind): fenced parts, headings, and runs of other lines without a blank one between them."""
    def starts(line: Column, before: Column, i: Column) -> Column:
        alone = (i == 0) | (before["kind"] != line["kind"]) | (line["kind"] == "heading") | (before["line"] == "")
        return F.when(line["kind"] == "code", (i == 0) | (before["kind"] != "code") | (line["part"] != before["part"])).otherwise(
            (text.strip(line["line"]) != "") & alone)

    return _groups(lines, starts)


def _kinds(raw: Column, fences: Column) -> Column:
    """Every line with its kind: code inside a fence (the number of the part, -1 on its marks), heading or other."""
    # Which part a line is in: the parts are in order, so the last one that has begun is looked up by place.
    def kind(line: Column, i: Column) -> Column:
        part = F.get(fences, F.size(F.filter(fences, lambda p: p["first"] <= i)) - 1)
        inside = F.coalesce(part["last"] >= i, F.lit(False))
        value = F.when(inside & ((part["first"] == i) | (part["last"] == i)), "").otherwise(line)
        heading = line.rlike(_HEADING) & (text.strip(F.regexp_extract(line, _HEADING, 2)) != "")
        return F.struct(
            value.alias("line"), F.when(inside, "code").when(heading, "heading").otherwise("other").alias("kind"),
            F.when(inside, part["first"]).otherwise(-1).alias("part"))

    return F.transform(raw, kind)


def _written(group: Column) -> Column:
    """The lines of a group that are not blank."""
    return F.filter(F.transform(group, lambda g: g["line"]), lambda value: text.strip(value) != "")


def _markdown_blocks(group: Column, lines: Column) -> Column:
    """The blocks of one group, ``lines`` being its ``_written`` ones."""
    first = F.get(group, F.lit(0))
    line = first["line"]
    second = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    whole = F.array_join(lines, "\n")
    none = F.lit(None)
    rest = F.array_join(F.slice(lines, 3, F.size(lines)), "\n")
    underlined = F.array(
        _block(_inline(line), F.when(second.startswith("="), 1).otherwise(2)), _block(_inline(rest), none))
    cells = F.flatten(F.transform(
        F.filter(lines, lambda value: ~value.rlike(_TABLE)),
        lambda row: F.split(F.regexp_replace(text.strip(row), r"^\||\|$", ""), r"(?<!\\)\|")))
    quoted = F.array_join(F.transform(lines, lambda value: F.regexp_replace(value, r"^ {0,3}> ?", "")), "\n")
    items = F.transform(
        _groups(lines, lambda value, before, i: (i == 0) | value.rlike(_ITEM)),
        lambda some: _block(_inline(F.array_join(F.transform(some, lambda value: F.regexp_replace(
            value, r"^[ \t]*(?:[*+-]|\d+\.)[ \t]+", "")), "\n")), none))
    return (
        F.when(first["kind"] == "code", F.array(_block(text.clean_text(F.array_join(F.transform(group, lambda g: g["line"]), "\n")), none)))
        .when(first["kind"] == "heading", F.array(_block(
            _inline(F.regexp_extract(line, _HEADING, 2)), F.length(F.regexp_extract(line, _HEADING, 1)))))
        .when(second.rlike(_UNDERLINE) & ~line.rlike(_ITEM), underlined)
        .when((F.size(lines) == 1) & line.rlike(_RULE), F.array().cast("array<struct<text:string,heading_level:int>>"))
        .when(line.contains("|") & second.contains("-") & second.rlike(_TABLE), F.array(_block(
            _inline(F.array_join(F.transform(cells, text.strip), "\n\n")), none)))
        .when(line.rlike("^ {0,3}>"), F.array(_block(_inline(quoted), none)))
        .when(line.rlike(_ITEM), items)
        .otherwise(F.array(_block(_inline(whole), none)))
    )


def blocks_from_markdown(docs: DataFrame, doc_id: str = "document_id", content: str = "content") -> DataFrame:
    """Blocks of Markdown as its rendered page has them, without rendering it.

    Headings (# marks or underlined) keep their level; paragraphs, fenced code, tables, quotes and list items are body
    blocks, what is nested in an item or a quote belonging to it. Cells of a table and marked-up words are lines of
    their own. A list begins after a blank line; rules are no blocks; raw HTML is text.
    """
    staged = _staged(docs, [doc_id], {
        "_raw": text.lines(F.coalesce(F.col(content), F.lit(""))),
        "_fences": _fences(F.col("_raw")),
        "_lines": _kinds(F.col("_raw"), F.col("_fences")),
        "_groups": _markdown_groups(F.col("_lines")),
    })
    groups = staged.select(doc_id, F.posexplode_outer("_groups").alias("at", "group")).where("at is not null")
    written = groups.withColumn("_written", _written(F.col("group")))
    parts = written.select(doc_id, "at", F.posexplode_outer(_markdown_blocks(F.col("group"), F.col("_written"))).alias("inner", "block"))
    kept = parts.where("block.text <> ''").select(doc_id, "at", "inner", "block.*")
    order = Window.partitionBy(doc_id).orderBy("at", "inner")
    return kept.select(
        doc_id, (F.row_number().over(order) - 1).alias("pos"), "text", F.lit(None).cast("int").alias("page_number"), "heading_level")


def parsed_blocks(docs: DataFrame, doc_id: str = "document_id", content: str = "content", mime: str = "mime") -> DataFrame:
    """Blocks by the reader of each document's type: Markdown, HTML, or plain text for all others that have text."""
    kind = F.coalesce(F.col(mime), F.lit(""))
    readers = (
        (blocks_from_markdown, kind == "text/markdown"), (blocks_from_html, kind == "text/html"),
        (blocks_from_text, ~kind.isin("text/markdown", "text/html")))
    parts = [reader(docs.where(which), doc_id, content) for reader, which in readers]
    return reduce(DataFrame.unionByName, parts)


def decode_blocks(docs: DataFrame, doc_id: str, blocks: str, content: str) -> DataFrame:
    """Stored JSON blocks; an unreadable or empty value is one unstructured block."""
    whole = F.array(F.struct(
        F.col(content).alias("text"),
        F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("int").alias("heading_level"),
    ))
    parsed = F.from_json(F.col(blocks), BLOCK)
    usable = F.when(F.size(parsed) > 0, parsed)
    return docs.select(
        doc_id, F.posexplode(F.coalesce(usable, whole)).alias("pos", "block")
    ).select(doc_id, "pos", "block.*")


class _Walk(HTMLParser):
    """Collects block elements of one page in document order."""

    BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "table", "blockquote"}
    OWNERS = {"li", "pre", "table", "blockquote"}
    SILENT = {"script", "style", "template"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
            "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.found: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        block = None
        if tag in self.BLOCKS:
            if not any(name in self.OWNERS for name, _ in self.open):
                block = len(self.found)
                self.found.append((tag, []))
        self.open.append((tag, block))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        if any(name in self.SILENT for name, _ in self.open):
            return
        for _, block in self.open:
            if block is not None:
                self.found[block][1].append(data)


def _walk_html(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_steps(batches, 1):
        page, pos, raw, level = [], [], [], []
        for at, html in enumerate(batch.column(1).to_pylist()):
            walk = _Walk()
            walk.feed(html or "")
            walk.close()
            for number, (tag, parts) in enumerate(walk.found):
                page.append(at)
                pos.append(number)
                raw.append("\n".join(parts))
                level.append(int(tag[1]) if tag[0] == "h" else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(page, pa.int32())), pa.array(pos, pa.int32()), pa.array(raw, pa.string()), pa.array(level, pa.int32())],
            ["doc", "pos", "raw", "heading_level"])


def blocks_from_html(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """h1-h6, p, li, pre, table and blockquote in order; nested ones belong to their owner."""
    ship(pages.sparkSession)
    key_type = pages.schema[page_id].dataType.simpleString()
    walked = pages.select(page_id, html).mapInArrow(
        _walk_html, f"doc {key_type}, pos int, raw string, heading_level int"
    )
    return (
        walked.withColumn("text", text.clean_text(F.col("raw")))
        .where("text <> ''")
        .select(F.col("doc").alias(page_id), "pos", "text",
                F.lit(None).cast("int").alias("page_number"), "heading_level")
    )


def html_headings(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Headings only, without leaving the JVM; one row per h1..h6."""
    pattern = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    levels = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(levels.alias("level"), bodies.alias("body"))
    return pages.select(page_id, F.posexplode(pairs).alias("pos", "h")).select(
        page_id, "pos", F.col("h.level").cast("int").alias("heading_level"),
        text.squash(F.regexp_replace("h.body", "<[^>]*>", " ")).alias("title"),
    )
