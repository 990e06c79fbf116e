"""Wrappers against pages whose main text is known, without and with elements that name it; hostile pages."""

import random
import time

import pytest

from millrace.llm import html_extract
from millrace.llm.html_extract import main_text, parse

WORDS = [f"w{i}" for i in range(500)]


def sentence(r, n=None):
    return " ".join(r.choices(WORDS, k=n or r.randrange(6, 40)))


def site(r, host, pages, layout):
    """Pages of a host, as html with its main text."""
    name, rights, about = (sentence(r, 4) for _ in range(3))
    out = []
    for i in range(pages):
        body = [sentence(r) for _ in range(r.randrange(1, 12))]
        links = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in r.choices(WORDS, k=5))
        text = "".join(f"<p>{x}</p>" for x in body)
        extra = f"<div><p>{about}</p></div>" if i % 2 or i > 5 else ""  # template that the first page lacks
        if layout == "divs" or layout == "two" and i % 2:
            page = f"<html><head><title>t</title></head><body><div><b>{name}</b></div><div><ul>{links}</ul></div><div><h1>{body[0]}</h1>{text}</div>{extra}<div>{rights}</div></body></html>"
        elif layout == "two":
            page = f"<html><body><table><tr><td>{name}</td></tr><tr><td><h2>{body[0]}</h2>{text}</td><td>{rights}</td></tr></table></body></html>"
        else:
            page = f"<html><body><nav><ul>{links}</ul></nav><article><h1>{body[0]}</h1>{text}</article><footer>{rights}</footer></body></html>"
        out.append((f"https://{host}.org/{i}", page, "\n\n".join([body[0], *body])))
    return out


@pytest.mark.parametrize("layout", ["divs", "two", "article"])
def test_main_text_is_found(spark, layout):
    r = random.Random(layout)
    rows = [x for k in range(3) for x in site(r, f"h{k}", 30, layout)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_extract.extract(df).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(rows)}


def test_the_wrapper_decides(spark):
    """Without a skeleton, template and other furniture come out as main text."""
    rows = site(random.Random(1), "h", 30, "divs")
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    pages = df.selectExpr("page_id", "url", "html", "'h' as host").toPandas()
    alone = [main_text(h, None, {}) for h in pages["html"]]
    assert all(a != t for a, (_, _, t) in zip(alone, rows, strict=True))


def test_copies_on_a_host_keep_their_text(spark):
    page = "<html><body><article><h1>Title</h1><p>One text, many times</p></article><footer>f</footer></body></html>"
    df = spark.createDataFrame([(i, f"https://c.org/{i}", page) for i in range(30)], "page_id long, url string, html string")
    assert {x.text for x in html_extract.extract(df).collect()} == {"Title\n\nOne text, many times"}
    bare = "<html><body><p>One text, many times</p></body></html>"
    df = spark.createDataFrame([(i, f"https://c.org/{i}", bare) for i in range(30)], "page_id long, url string, html string")
    assert {x.text for x in html_extract.extract(df).collect()} == {"One text, many times"}


def test_what_an_article_holds_stays():
    page = "<body><article><header><h1>T</h1></header><pre><code><span class='comment'># note</span> x=1</code></pre><p>f <math><mi>x</mi><mo>=</mo><mn>1</mn></math> g</p><div class='related-work'><h2>Related work</h2><p>para</p></div><p class='alert'>careful</p><div class='ad'>buy</div><section id='comments'><p>me too</p></section><form>f</form></article></body>"
    assert main_text(page, None, {}) == "T\n\n# note x=1\n\nf x=1 g\n\nRelated work\n\npara\n\ncareful"


HOSTILE = {
    "deep": "<div>" * 20_000 + "text" + "</div>" * 20_000,
    "open tags": "<a " * 350_000,
    "open quotes": '<a "' * 250_000 + ">",
    "scripts": "<script>" * 120_000,
    "end tags": "</div>" * 170_000,
    "unmatched": "<div>" * 50_000 + "</p>" * 50_000,
    "items": "<ul>" + "<li>x" * 100_000,
    "brackets": "<" * 1_000_000,
    "comments": "<!--" * 250_000,
}


@pytest.mark.parametrize("kind", list(HOSTILE))
def test_hostile_pages_take_linear_time(kind):
    began = time.process_time()
    main_text(HOSTILE[kind], None, {})
    skeleton = html_extract.skeleton([parse(HOSTILE[kind])] * 3)
    html_extract.placed(HOSTILE[kind], skeleton)
    assert time.process_time() - began < 20


def test_lists_beyond_the_table_are_aligned_whole():
    """600 constant blocks, and more than the table holds, are all template."""
    page = lambda i: "<body>" + "".join(f"<p>fixed {k}</p>" for k in range(600)) + f"<p>own {i}</p>" * 600 + "</body>"
    base = html_extract.skeleton([parse(page(i)) for i in range(4)])
    places = [{n.text: k for k, n, _ in html_extract.placed(page(i), base)} for i in (7, 8)]
    assert all(places[0][f"fixed {k}"] == places[1][f"fixed {k}"] >= 0 for k in range(600))
