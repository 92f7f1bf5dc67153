from datetime import datetime

from corpusframe.functions import text


def test_tokens_keep_digits_and_short_words(column):
    assert column(text.tokens, "Form TR-77 or 12 days, b2", "", None) == [
        ["form", "tr", "77", "or", "12", "days", "b2"], [], []]


def test_clean_text(column):
    assert column(text.clean_text, "  a \r\n\r\n\r\n b\rc  \n") == ["a\n\nb\nc"]


def test_content_hash_ignores_spacing(column):
    a, b, c = column(text.content_sha256, "one  two\n", "one two", "onetwo")
    assert a == b != c


def test_heading_levels(column):
    cases = {
        "4. Leave": 2, "4.2 Annual Leave": 3, "1.1.1.1.1.1.1 Deep": 6, "Section 4 Scope": 2,
        "Version: 6.2": None, "LEAVE POLICY": 1, "Maternity Leave": 1, "Employees accrue days.": None,
        "Leave": None, "Maternity leave rules": None, "": None, "X" * 121: None, "Is This Right?": None,
        "1. Numbered sentence.": 2, "2026": None, "NOTE:": None,
    }
    assert column(text.heading_level, *cases) == list(cases.values())


def test_failures(spark):
    from pyspark.sql import functions as F

    cases = [
        ("AuthenticationError", "x", "provider", "auth", False), ("E", "insufficient_quota", "provider", "quota", False),
        ("RateLimitError", "429", "provider", "rate_limit", True), ("E", "Connection refused", "provider", "unreachable", True),
        ("E", "model not found", "provider", "model_missing", False), ("E", "Read timeout", "provider", "timeout", True),
        ("E", "got 503", "provider", "server", True), ("ParseError", "x", "parse", "parse", False),
        ("FileNotFoundError", "x", "storage", "storage", True), ("ValueError", "odd", "unknown", "unknown", True),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, e string, m string")
    got = df.select("i", text.failure(F.col("e"), F.col("m")).alias("f")).orderBy("i").collect()
    assert [tuple(r["f"]) for r in got] == [c[2:] for c in cases]


def test_smalltalk(column):
    cases = {
        "howdy": "greeting", "Good   Morning!!": "greeting", "  YO  ": "greeting", "heya ;-)": "greeting", "how's it going": "greeting",
        "Many thanks.": "thanks", "gotcha": "thanks", "take care": "farewell", "who are you??": "capability", "what is this": "capability",
        "hey, where may I park a bicycle?": None, "thanks for nothing": None, "bye 77": None, "": None, "?!": None,
        "cheers " * 40: None, "hiking": None,
    }
    assert column(text.smalltalk_kind, *cases) == list(cases.values())


def test_library_wide(column):
    yes = [
        "Which files talk of bicycle racks?", "What policies deal with laptops?",
        "What does each handbook ask of visitors?", "Compare canteen prices in both files",
        "Show the newest files on recycling", "How many files describe fire drills?",
        "Do any documents describe lost badges?", "Look across the library for pensions",
        "Summarize the files on heating", "Does every file name an owner?",
    ]
    no = [
        "How long is the lunch break?", "How many parking bays are free?", "What does form TR-77 ask for?",
        "Where are visitors signed in?", "Explain the badge rules", "",
    ]
    assert column(text.is_library_wide, *yes, *no) == [True] * 10 + [False] * 6
    assert all(column(text.matched_pattern, *yes)) and not any(column(text.matched_pattern, *no))


def test_topic_terms(column):
    assert column(
        text.topic_terms, "Which files cover bicycle racks?", "Show me every document on fire drills", "Compare any files",
    ) == [["bicycle", "racks"], ["fire", "drills"], []]


def test_as_question(column):
    assert column(text.as_question, "leave policy", "What is leave?", "list leave types", "one two three four five six seven", " ") == [
        "What do the documents say about leave policy?", "What is leave?", "list leave types",
        "one two three four five six seven", ""]


def test_self_contained(column):
    cases = {
        "Which files talk of bicycles?": True, "what about garages?": False, "price per metre?": False,
        "How long may visitors keep a bicycle in their bay?": False,
        "How long may visitors keep a bicycle inside the north garage?": True, "Who may park?": False,
        "no the bicycle racks near gate two": False, "i meant bicycle racks for visitors only": False,
        "Which form covers lost badges of temporary workers?": True,
    }
    assert column(text.looks_self_contained, *cases) == list(cases.values())


def test_needs_calculation(column):
    cases = {"What does form TR-77 ask for?": False, "I used 3 vouchers, how many remain?": True,
             "12 and 5 metres": True, "nothing left over": False, "40% off": True}
    assert column(text.needs_calculation, *cases) == list(cases.values())


def test_citations(column):
    assert column(text.cited_numbers, "First [5]. Then [2][5]. Last [4]", "[7, 8]", "[annex]", "none", "[ 4 ,x, 4]", "[99999999999999999999]") == [
        [5, 2, 4], [7, 8], [], [], [], [None]]
    assert column(text.is_degenerate, "[2]", "A proper answer in words [2].", "Fourteen lettr", "") == [True, False, True, True]


def test_excerpts_and_clips(column):
    long = "First sentence ends here. " + "word " * 10
    assert column(lambda c: text.excerpt(c, 40), long, "short  one", "x" * 50) == [
        "First sentence ends here.", "short one", "x" * 40 + "…"]
    assert column(text.clip_title, "  a  b ", "", None, "y" * 81) == ["a b", "Untitled", "Untitled", "y" * 80 + "…"]


def test_domain(column):
    assert column(text.domain_of, "https://acme.com/hr/leave", "http://www.acme.com", "acme.com/x", "//h.org/a", "", None) == [
        "acme.com", "acme.com", "web", "h.org", "web", "web"]


def test_utc_iso(column):
    assert column(text.to_utc_iso, datetime(2026, 1, 2, 3, 4, 5), datetime(2026, 1, 2, 3, 4, 5, 120000), None, kind="timestamp") == [
        "2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.120000+00:00", None]


def test_small_projections(column, spark):
    from pyspark.sql import functions as F

    assert column(text.chunk_index_of, "doc:7", "a:b:12", "doc", "doc:x") == [7, 12, 0, 0]
    assert column(text.normalise_question, "  What  IS\tleave? ") == ["what is leave?"]
    assert column(text.file_kind, "a.PDF", "b.md", "c.xyz") == ["PDF", "Markdown", "XYZ"]
    df = spark.createDataFrame([("f.md", "1.2 Leave", 12), ("f.md", None, None)], "f string, t string, p int")
    assert [r[0] for r in df.select(text.citation_label(F.col("f"), F.col("t"), F.col("p"))).collect()] == [
        "f.md, Section 1.2 Leave, Page 12", "f.md"]


def test_claim_key(column):
    assert column(text.claim_key, "days of paid annual leave.", "days paid annual leave", "class of glass boxes") == [
        ["day", "paid", "annual", "leave"], ["day", "paid", "annual", "leave"], ["class", "glass", "boxe"]]
