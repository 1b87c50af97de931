"""Wrapper inference, tag soup, and the whole pages table against a plain reading of its article."""

import html
import itertools
import json
import random
import re

from pyspark.sql import functions as F

from cairn.llm import wrapper_extract as we


def plain(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_every_page_gives_its_article(spark, table):
    want = {r.page_id: plain(r.html) for r in table("pages").collect()}
    got = we.main_text(table("pages")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_boilerplate_of_many_kinds_goes():
    page = """<html><body><header><h2>Site</h2></header><nav><ul><li>a<li>b</ul></nav><div class="left-sidebar">x</div>
    <article><h1>T &amp; U</h1><!-- c --><div class="ad">buy</div><p>One  <b>two</b>
    three&nbsp;x &lt;b&gt;<p>Four<br>five<ul><li>i1<li>i2 <ul><li>n</ul></ul><table><tr><td>c1<td>c2</table>
    <section class="reader-comments"><p>hey</p></section><form><input>zz</form><div style="display: none">h</div></article>
    <div id="cookie-notice">ok</div><aside>s</aside><footer>f</footer><script>var a="</article><p>no";</script></body></html>"""
    assert we.extract(page, {}) == "T & U\nOne two three x <b>\nFour five\ni1\ni2\nn\nc1\nc2"


def test_wrapper_without_article_has_slots_repeats_and_optionals():
    pages = [f"<body><div id=top>Menu</div><div class=page><div class=x><h1>Title {i}</h1>{'<h3>Sub</h3>' if i == 2 else ''}<p>Para {i} of a long text {i * 7}<p>More {i}"
             f"{'<p>extra' if i % 2 else ''}</div><div class=y>Same everywhere</div></div></body>" for i in range(5)]
    wrapper = we.infer(pages)
    assert wrapper.expression() == "<#page><body><div.top>'Menu'</div.top><div.page><div.x><h1>#SLOT</h1>(<h3>'Sub'</h3>)?(<p>#SLOT</p>)+</div.x><div.y>'Same everywhere'</div.y></div.page></body></#page>"
    assert we.extract(pages[3], we.labels(wrapper, 5)) == "Title 3\nPara 3 of a long text 21\nMore 3\nextra"


def test_defined_cases(spark):
    rows = [(1, None, None), (2, "http://a.b/c", ""), (3, "http://u@A.b:80/d", "plain &amp; text\n\n x"), (3, "http://u@A.b:80/d", "plain &amp; text\n\n x"), (None, "nonsense", "<p>x<p>" + "y " * 60_000), (5, "http://c.d", "<article><p>a<article><p>b</article><p>c</article><p>d")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.text[:20], r.n_chars) for r in we.main_text(df).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "plain & text x", 14), (None, "x\n" + "y " * 9, 120_001), (5, "a\nb\nc", 5)}
    assert we.main_text(df).count() == 6 and we.main_text(df.limit(0)).count() == 0
    assert {r.h for r in df.select(we.host_of(df.url).alias("h")).collect()} == {"", "a.b", "a.b:80", "c.d"}


def test_host_that_mixes_article_main_and_div_pages(spark):
    menu, foot = '<div class="top bar"><a href=/>Home</a> <a href=/n>News</a></div>', "<div class=base>Imprint of the house</div>"
    kinds = [
        lambda b: f"<article>{b}</article><article class=comment><p>I agree</p></article>",
        lambda b: f"<main>{b}</main>",
        lambda b: f"<div class=content>{b}</div><article class=comment><p>I agree</p></article>",
        lambda b: f"<div class=layout><div class=story>{b}</div></div>",
    ]
    rows, want = [], {}
    for i in range(240):
        kind = 0 if i < 200 else 1 + i % 3  # eight sampled pages of the host hold few of the others
        body = f"<h1>Title {i}</h1><p>Text {i} with <b>some</b> words {i * 31}</p>" + ("<p>More of it</p>" if i % 7 == 0 else "")
        rows.append((i, f"http://mixed.example/{i}", f"<html><body>{menu.replace('top', 'lead')}{kinds[kind](body)}{foot}</body></html>"))
        want[i] = f"Title {i}\nText {i} with some words {i * 31}" + ("\nMore of it" if i % 7 == 0 else "")
    got = {r.page_id: r.text for r in we.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_wrapper_decides_pages_without_their_own_article(spark):
    """The whole table with article and main renamed to plain elements: the same texts, found by the wrapper alone.

    On 2,500 pages: with a few pages of a template, a block that two of them share would count as constant.
    """
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    renamed = pages.withColumn("html", F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div"))
    assert renamed.where(F.col("html").contains("<article")).count() == 0
    want = {r.page_id: r.text for r in we.main_text(pages).collect()}
    assert {r.page_id: r.text for r in we.main_text(renamed).collect()} == want


def test_labels_of_the_wrapper_decide_pages_with_an_article(spark):
    """Every page is joined with its template's wrapper, and a place follows the label that it gives."""
    page = "<body><div class=lead>Menu</div><article><h1>T</h1><p>One</p></article></body>"
    tree = we.parse(page)
    labels = we.labels(we.infer([page]), 1)
    assert we.content(tree, "article", we.Known(labels)) == "T\nOne"
    assert we.content(tree, "article", we.Known({k: v and not k.endswith("/h1") for k, v in labels.items()})) == "One"
    assert we.content(tree, "article", we.Known({})) == "T\nOne"  # unknown places: the page's own article
    rows = [(i, "http://h.x", page.replace("One", f"One {i}")) for i in range(5)] + [(9, "http://h.x", page.replace("article", "main"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", we.host_of(F.col("url")))
    seen = we.surveyed(df)
    assert seen.count() == 6 and seen.select("template").distinct().count() == 2
    assert we.wrappers(seen).count() == 2


def test_every_page_of_a_template_takes_part_in_its_wrapper(spark):
    """One page in 300 has another element: the wrapper knows it, in any order and dealing of the pages."""
    pages = [f"<body><div class=lead>Menu</div><main><p>One {i}</p>{'<h4 class=rare>Rare</h4>' if i == 171 else ''}{'<p hidden>no</p>' if i % 90 == 1 else ''}</main></body>" for i in range(300)]
    rows = [(i, f"http://h.x/{i}", page) for i, page in enumerate(pages)]
    found, texts = set(), set()
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts).withColumn("host", we.host_of(F.col("url")))
        (row,) = we.wrappers(we.surveyed(df)).collect()
        assert "<h4.rare>'Rare'</h4.rare>" in row.expression
        found.add(row.wrapper)
        texts.add(tuple(sorted((r.page_id, r.text) for r in we.main_text(df).collect())))
    assert len(found) == 1 and len(texts) == 1
    assert dict(texts.pop()) == {i: f"One {i}" + ("\nRare" if i == 171 else "") for i in range(300)}


def test_partial_wrappers_align_as_their_pages_do():
    pages = [f"<body><article><h1>T{i}</h1>{'<ul><li>a<li>b</ul>' * (i % 3)}<p>x{i}</p></article><div{' role=menu' if i % 4 == 0 else ''}>c</div></body>" for i in range(9)]
    whole = we.Aligned()
    for page in pages:
        item = we.item_of(we.parse(page))
        again = we.unpacked(we.packed(item))
        assert again.expression() == item.expression() and we.packed(again) == we.packed(item)
        whole.add(again)
    wrapper = whole.whole()
    assert wrapper.seen == 9 and we.labels(wrapper, 9, ()) == we.labels(we.infer(pages[::-1]), 9, ())
    # a label that the page's own article tells as well need not travel
    assert we.told(wrapper, "article", ()) == {}


def test_pages_with_an_article_are_counted_and_every_place_has_a_label(spark):
    """The menu of one page without an article is told by the host's pages that have one."""
    menu, body = "<div class=lead>Home of a house and all its rooms</div>", "<p>Text {0} of the page</p>"
    pages = [f"<body>{menu}<article>{body.format(i)}</article></body>" for i in range(6)] + [f"<body>{menu}{body.format(6)}</body>"]
    df = spark.createDataFrame([(i, f"http://h.x/{i}", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in we.main_text(df).collect()} == {i: f"Text {i} of the page" for i in range(7)}
    seen = we.surveyed(df.withColumn("host", we.host_of(F.col("url"))))
    assert {r.page_id: len(r.blocks) for r in seen.collect()} == dict.fromkeys(range(7), 2)
    found = [json.loads(r.wrapper) for r in we.wrappers(seen).collect()]
    of_articles = {"": False, "body/article": True}
    assert [(x["region"], x["constant"]) for x in found if x["labels"] == of_articles] == [("", [])]
    assert [(x["labels"], len(x["constant"])) for x in found if x["labels"] != of_articles] == [({"": True}, 1)]


def test_few_elements_give_the_labels_of_all_places():
    rng = random.Random(3)
    for _ in range(300):
        paths = {"/".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 40))}
        labels = {p: rng.random() < 0.5 if rng.random() < 0.3 else p.startswith("a/b") for p in paths}
        known = we.Known(subtrees=we.subtrees(labels))
        assert {p: known.label(p) for p in paths} == labels and len(known.subtrees) <= len(labels) + 1
    inline = {f"body/main/article/p/{'/'.join(x)}": True for x in itertools.product("abi", repeat=6)}
    assert we.subtrees(inline | {"body/div": False, "body/main/h2": False, "": False}) == {"": False, "body/main/article": True}


def test_an_article_in_a_header_takes_no_text_from_the_template(spark):
    """Pages of a template with a teaser in the header, and of one with an article in its main and another beside it."""
    teaser = "<header><article>Teaser</article></header>"
    pages = [f"<body>{teaser if i in (2, 5) else ''}<{tag}><p>Text {i} of the page</p></{tag}></body>" for i, tag in enumerate(["main"] * 4 + ["section"] * 4)]
    pages += [f"<body><main><article><p>Text {i} of the page</p></article></main><article><p>More {i}</p></article></body>" for i in (8, 9)]
    df = spark.createDataFrame([(i, f"http://h.x/{i}", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in we.main_text(df).collect()}
    assert got == {i: f"Text {i} of the page" + (f"\nMore {i}" if i > 7 else "") for i in range(10)}
