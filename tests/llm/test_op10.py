import html
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusframe.llm import op10_html as pages
from corpusframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return pages.fit(spark, pages.sample_texts(spark.read.parquet(f"{FOLDER}/pages.parquet")))


def article(page):
    """The article of the given tables' one template, by plain patterns."""
    body = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", part))).strip() for part in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_query_equals_the_articles(spark):
    raw = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = QUERIES["op10_html"](spark, FOLDER).collect()
    assert len(got) == len(raw)
    assert all(r.text == article(raw[r.page_id].html) and r.n_chars == len(r.text) and r.url == raw[r.page_id].url for r in got)


@pytest.mark.parametrize("page, blocks", [
    ("", []), ("plain &amp; text", ["plain & text"]), ("<p>a<p>b <b>c</b><br>d", ["a", "b c d"]),
    ("<ul><li>a<li>b</ul>", ["a", "b"]), ("<script>var x='<p>no</p>'</script><!-- <p> -->y", ["y"]), ("<p>1 &lt; 2</p></div>x", ["1 < 2", "x"]),
    ("<p title='a>b'>t", ["t"]), ("<style>p{}", []), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("a < b", ["a < b"]),
])
def test_reading(page, blocks):
    nodes = pages.parse(page)
    assert [t for _, t, _ in sorted(b for n in nodes for b in n.blocks)] == blocks


@pytest.mark.parametrize("page, blocks", [
    ("<datalist><option value=a><option value=b></datalist><article><p>text", ["text"]),
    ("<p>pick <select><optgroup label=x><option>a<option>b<optgroup><option>c</select> now<p>text", ["pick now", "text"]),
    ("<form><select><option>a<option>b<option>c</form><p>text", ["text"]), ("<select><option>a<article><p>text", ["text"]),
    ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then<p>y", ["if x=2 then", "y"]), ("<p>a <math><mi>x<p>b", ["a x", "b"]),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr></mtable></math>", ["1 2"]),
    ("<p>an <svg><title>no</title><path d=''/></svg> icon", ["an icon"]), ("<p>a <svg><text>label</text></svg> b<svg/>c<p>d", ["a bc", "label", "d"]),
    ("<div>a <svg><path d=''><p>b</div>c", ["a", "b", "c"]), ("<p>a<iframe src=x><p>b", ["a", "b"]), ("<canvas><p>a", ["a"]),
    ("<object data=x><param name=y><p>a</object>b", ["a", "b"]),
])
def test_reading_embedded(page, blocks):
    nodes = pages.parse(page)
    assert [t for _, t, _ in sorted(b for n in nodes for b in n.blocks)] == blocks
    assert all(n.parent < i for i, n in enumerate(nodes))


def test_search_box_above_the_article(model):
    body = "".join(f"<p>{'This is a sentence of the story that goes on. ' * 4}<math><mi>E{i}</mi></math></p>" for i in range(4))
    page = f"<body><form><input list=q><datalist><option value=a><option value=b></datalist></form><main><h1>A title</h1>{body}</main>"
    text = pages.main_text(page, model)
    assert text.startswith("A title\nThis is") and text.endswith("E3")


def test_decoding_is_hierarchical(model):
    nodes = pages.parse("<div><p>" + "a b c. " * 30 + "<div><p>" + "d e f. " * 30)
    odds = [-6.0] * len(nodes)
    assert not pages.decode(nodes, odds).any()
    kept = pages.decode(nodes, [1.0] * len(nodes))
    assert all(not k or nodes[i].parent < 0 or kept[nodes[i].parent] for i, k in enumerate(kept))


def test_laid_out_pages(spark, model):
    rng, right, all_nodes = random.Random(5), 0, 0
    texts = pages.sample_texts(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    for _ in range(60):
        x, y = pages._labelled(pages._layout(rng, texts))
        right += ((model.log_odds(x) > 0) == (y == 1)).sum()
        all_nodes += len(y)
    assert right > 0.97 * all_nodes


def test_another_template(model):
    body = "".join(f"<p>{'This is a sentence of the story that goes on. ' * 4}</p>" for _ in range(4))
    page = f"""<body><header class="site-header"><a href=/>Home</a></header><div id="cookie-notice">We use cookies. <button>OK</button></div>
      <div class="navbar"><a href=1>One</a> <a href=2>Two</a></div><main><h1>A title</h1>{body}<ul><li>first point<li>second point</ul></main>
      <aside class="sidebar"><h4>Related</h4><ul><li><a href=3>Three</a></ul></aside>
      <section class="comments"><div class="comment"><p>I liked this one a lot, thanks for writing it.</p></div></section>
      <form><label>Search</label><input></form><footer>&copy; 2024 Somebody</footer></body>"""
    text = pages.main_text(page, model)
    assert text.startswith("A title\nThis is a sentence") and text.endswith("first point\nsecond point")
    assert not re.search("cookies|Home|One|Related|liked|Search|Somebody", text)


def test_strange_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>Some text here.</p>"), (3, "w", "<div>" * 3000 + "deep"), (4, "x", "<article><p>" + "Long text. " * 100_000), (4, "x", "<b>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("y"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in pages.extract(df, model).collect())
    assert len(got) == 6 and got[1] == (1, "", 0) and got[2] == (2, "", 0)
    assert pages.extract(df.limit(0), model).count() == 0
    assert pages.extract(df.limit(0)).count() == 0
