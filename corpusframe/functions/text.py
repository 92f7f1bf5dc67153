"""Column functions over text. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusframe.functions import fixed

# Unicode white space plus the four ASCII separators that also count as white space.
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ELLIPSIS = "…"
# A numbered line; the number is its first group.
NUMBERED_HEADING = r"(?i)^(?:section\s+)?(\d+(?:\.\d+)*)\.?\s+\S"


def words_in(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def tokens(text: Column) -> Column:
    """Lowercase alphanumeric tokens; digits and short tokens are kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(fixed.TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def squash(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def clean_text(text: Column) -> Column:
    """Strip every line, keep at most one blank line in a row, strip the whole."""
    stripped = F.array_join(F.transform(lines(text), strip), "\n")
    return strip(F.regexp_replace(stripped, "\n{3,}", "\n\n"))


def content_sha256(text: Column) -> Column:
    return F.sha2(squash(text), 256)


def file_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def heading_level(line: Column, stripped: bool = False) -> Column:
    """Level of a heading guessed from the shape of a line, else null. ``stripped``: the line has no white space at its ends."""
    s = line if stripped else strip(line)
    number = F.regexp_extract(s, "(?U)" + NUMBERED_HEADING, 1)
    numbered = number != ""
    words = F.size(F.split(squash(s), " "))
    upper = s.rlike(r"(?U)\p{Upper}") & ~s.rlike(r"(?U)\p{Lower}|\p{Lt}") & s.rlike(r"\p{L}")
    lower_start = s.rlike(rf"(?U)(?:^|{SPACE})[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]")
    return (
        F.when((s == "") | (F.length(s) > fixed.MAX_HEADING_CHARACTERS), F.lit(None))
        .when(numbered, F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6)))
        .when(s.rlike("[.,;:]$"), F.lit(None))
        .when(s.rlike(fixed.LABELLED_LINE), F.lit(None))
        .when(upper & (words <= 12), F.lit(1))
        .when((words > 1) & (words <= 8) & ~s.rlike("[.?!]$") & ~lower_start, F.lit(1))
        .cast("int")
    )


def failure(error_type: Column, message: Column) -> Column:
    """struct(kind, reason, retryable) of an ingestion failure; the first match wins."""
    haystack = F.lower(F.concat_ws(" ", error_type, message))

    def has(needles):
        return any_of([haystack.contains(n) for n in needles])

    def outcome(kind, reason, retryable):
        return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"),
                        F.lit(retryable).alias("retryable"))

    chain = None
    for reason, needles, retryable in fixed.PROVIDER_FAILURES:
        result = outcome("provider", reason, retryable)
        chain = F.when(has(needles), result) if chain is None else chain.when(has(needles), result)
    return (
        chain.when(has(fixed.PARSE_FAILURES), outcome("parse", "parse", False))
        .when(has(fixed.STORAGE_FAILURES), outcome("storage", "storage", True))
        .otherwise(outcome("unknown", "unknown", True))
    )


def smalltalk_form(question: Column) -> Column:
    lowered = F.lower(F.coalesce(question, F.lit("")))
    spaced = F.regexp_replace(lowered, r"(?U)[^a-z0-9\s\x1c-\x1f]+", " ")
    return squash(spaced)


def smalltalk_kind(question: Column) -> Column:
    """greeting / thanks / farewell / capability for an exact phrase, else null."""
    form = smalltalk_form(question)
    short = (F.length(question) <= fixed.SMALLTALK_MAX_CHARACTERS) & (form != "")
    chain = None
    for kind, phrases in fixed.SMALLTALK.items():
        hit = short & form.isin([p.replace("'", " ") for p in phrases])
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain


def is_library_wide(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    return any_of([q.rlike("(?iUd)" + p) for p in fixed.LIBRARY_WIDE])


def matched_pattern(question: Column) -> Column:
    """Text of the first library-wide signal that fires, else null."""
    q = F.coalesce(question, F.lit(""))
    return F.coalesce(
        *[F.nullif(F.regexp_extract(q, "(?iUd)" + p, 0), F.lit("")) for p in fixed.LIBRARY_WIDE]
    )


def topic_terms(question: Column) -> Column:
    scaffolding = words_in(fixed.SCAFFOLDING)
    return F.filter(
        tokens(question), lambda t: ~F.array_contains(scaffolding, t) & (F.length(t) > 2)
    )


def as_question(query: Column) -> Column:
    """A bare topic becomes something that can be answered."""
    s = strip(F.coalesce(query, F.lit("")))
    words = F.regexp_extract_all(F.lower(s), F.lit("[a-zA-Z']+"), F.lit(0))
    topic = (
        ~s.contains("?")
        & F.size(words).between(1, fixed.MAX_TOPIC_WORDS)
        & ~F.coalesce(F.get(words, F.lit(0)).isin(fixed.ASK_WORDS), F.lit(False))
    )
    return F.when(topic, F.concat(F.lit("What do the documents say about "), s, F.lit("?"))).otherwise(s)


def looks_self_contained(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    n_words = F.size(F.regexp_extract_all(q, F.lit("[A-Za-z0-9']+"), F.lit(0)))
    dependent = any_of([q.rlike("(?iUd)" + p) for p in fixed.DEPENDENT])
    return (
        F.when(is_library_wide(q), True)
        .when(n_words <= fixed.MAX_DEPENDENT_WORDS, False)
        .otherwise(~dependent)
    )


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + fixed.NUMBER), F.lit(0))


def needs_calculation(question: Column) -> Column:
    lowered = F.lower(F.coalesce(question, F.lit("")))
    count = F.size(numbers_in(lowered))
    intent = any_of([lowered.contains(word) for word in fixed.ARITHMETIC_INTENT])
    return F.when(count == 0, False).when(count >= 2, True).otherwise(intent)


def is_degenerate(answer: Column) -> Column:
    """Citation markers with no actual statement."""
    bare = F.regexp_replace(answer, "(?U)" + fixed.CITATION, "")
    return F.length(F.regexp_replace(bare, r"[^\p{L}]", "")) < fixed.MIN_ANSWER_LETTERS


def cited_numbers(answer: Column) -> Column:
    """Numbers of the [n] markers in order of first use (null for one beyond 64 bits)."""
    groups = F.regexp_extract_all(answer, F.lit("(?U)" + fixed.CITATION), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), strip)))
    return F.array_distinct(
        F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: p.try_cast("bigint"))
    )


def clip(text: Column, limit: int, squashed: bool = True) -> Column:
    """At most ``limit`` characters, marked with an ellipsis when cut."""
    value = squash(F.coalesce(text, F.lit(""))) if squashed else text
    cut = F.concat(F.regexp_replace(F.substring(value, 1, limit), r"(?U)[\s\x1c-\x1f]+$", ""), F.lit(ELLIPSIS))
    return F.when(F.length(value) <= limit, value).otherwise(cut)


def clip_title(question: Column) -> Column:
    value = squash(F.coalesce(question, F.lit("")))
    return clip(F.when(value == "", "Untitled").otherwise(value), 80)


def excerpt(content: Column, limit: int) -> Column:
    """Roughly one paragraph, ending on a sentence where that keeps over half."""
    value = squash(F.coalesce(content, F.lit("")))
    window = F.substring(value, 1, limit)
    # Greedy match: everything up to the last sentence end followed by a space.
    head = F.regexp_extract(window, r"(?s)^(.*[.?!]) ", 1)
    return (
        F.when(F.length(value) <= limit, value)
        .when(F.length(head) - 1 > limit // 2, head)
        .otherwise(F.concat(F.rtrim(window), F.lit(ELLIPSIS)))
    )


def domain_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    # A bare "www." host keeps its empty remainder; only a missing host is "web".
    return (
        F.when(host.startswith("www."), F.substring(host, 5, 1_000_000))
        .when(F.coalesce(host, F.lit("")) == "", "web")
        .otherwise(host)
    )


def to_utc_iso(ts: Column) -> Column:
    """ISO-8601 with offset; a naive time is UTC (the session runs in UTC)."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNotNull(), F.concat(
        whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")
    ))


def citation_label(filename: Column, section_title: Column, page_number: Column) -> Column:
    return F.concat_ws(
        ", ",
        filename,
        F.when(section_title != "", F.concat(F.lit("Section "), section_title)),
        F.concat(F.lit("Page "), page_number.cast("string")),
    )


def chunk_index_of(chunk_id: Column) -> Column:
    return F.coalesce(strip(F.substring_index(chunk_id, ":", -1)).try_cast("int"), F.lit(0))


def normalise_question(question: Column) -> Column:
    return F.lower(squash(F.coalesce(question, F.lit(""))))


def file_kind(filename: Column) -> Column:
    extension = F.lower(F.substring_index(filename, ".", -1))
    chain = None
    for key, label in fixed.FILE_KINDS.items():
        chain = F.when(extension == key, label) if chain is None else chain.when(extension == key, label)
    return chain.otherwise(F.upper(extension))


def claim_key(words: Column) -> Column:
    """First four meaningful words after a figure, crudely singular."""
    filler = words_in(fixed.CLAIM_FILLER)
    kept = F.filter(
        F.regexp_extract_all(F.lower(words), F.lit("[a-z]+"), F.lit(0)),
        lambda w: ~F.array_contains(filler, w),
    )
    singular = F.transform(
        F.slice(kept, 1, fixed.CLAIM_KEY_WORDS),
        lambda w: F.when(
            (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")
        ).otherwise(w),
    )
    return singular
