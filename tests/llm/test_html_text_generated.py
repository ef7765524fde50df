"""Pages made from known articles: the text that went in must come out, and sums must be those of a plain walk."""

import random
import time
from html import escape

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text


def sentence(rng, n):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)]
    return ", ".join(" ".join(words[i : i + 6]) for i in range(0, n, 6)).capitalize() + "."


def page(rng):
    """A page and its article's blocks."""
    blocks, html = [], []

    def put(tag, text):
        blocks.append(text)
        body = escape(text)
        if rng.random() < 0.3:
            at = body.rfind(" ") + 1
            body = f"{body[:at]}<b class=x>{body[at:]}</b><!-- {sentence(rng, 4)} -->"
        if rng.random() < 0.3:
            body = body.replace(" ", "\n   ", 2)
        html.append(f"<{tag}>{body}</{tag}>" if rng.random() < 0.8 or tag != "p" else f"<p>{body}")

    put("h1", sentence(rng, 5)[:-1])
    for _ in range(rng.randint(3, 9)):
        kind = rng.random()
        if kind < 0.7:
            put("p", sentence(rng, rng.randint(15, 60)) + rng.choice(["", " é & <i>"]))
        elif kind < 0.8:
            put("h2", sentence(rng, 4)[:-1])
            put("p", sentence(rng, 30))
        elif kind < 0.9:
            html.append("<ul>")
            for _ in range(3):
                put("li", sentence(rng, 6))
            html.append("</ul>")
        else:
            put("blockquote", sentence(rng, 20))
    links = "".join(f"<li><a href='/{i}'>{sentence(rng, 2)}</a></li>" for i in range(rng.randint(3, 9)))
    around = [
        f"<nav><ul>{links}</ul></nav>",
        f"<header><p>{sentence(rng, 12)}</p></header>",
        f"<ul class=plain>{links}</ul>",
        f"<div class='sidebar left'><p>{sentence(rng, 40)}</p></div>",
        f"<script>if (a < b) {{ document.write('<p>{sentence(rng, 30)}</p>') }}</script><style>p {{ color: red }}</style>",
        f"<div id='cookie-notice'><p>{sentence(rng, 25)}</p></div>",
    ]
    after = [f"<section class=comments><p>{sentence(rng, 50)}</p><p>{sentence(rng, 50)}</p></section>", f"<footer>{sentence(rng, 30)}<ul>{links}</ul></footer>", f"<form><p>{sentence(rng, 30)}</p></form>", f"<aside>{sentence(rng, 50)}</aside>"]
    opened, closed = rng.choice([("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div role=main>", "</div>"), ("<div class=content>", "</div>"), ("<div><div>", "</div></div>")])
    rng.shuffle(around)
    return f"<!doctype html><html><head><title>{sentence(rng, 3)}</title></head><body>{''.join(around[: rng.randint(0, 6)])}{opened}{''.join(html)}{closed}{''.join(after[: rng.randint(0, 4)])}</body></html>", blocks


@pytest.mark.parametrize("seed", range(60))
def test_what_goes_in_comes_out(seed):
    html, blocks = page(random.Random(seed))
    assert html_text.extract(html) == "\n".join(blocks)


def test_sums_are_those_of_a_plain_walk():
    def plain(node):
        letters = linked = 0
        links = int(node.tag == "a")
        for part in node.parts:
            if isinstance(part, str):
                letters += len(part.strip())
                linked += len(part.strip()) * node.link
            elif not part.out:
                a, b, c = plain(part)
                letters, linked, links = letters + a, linked + b, links + c
        return letters, linked, links

    for seed in range(10):
        for node in html_text._measure(html_text.parse(page(random.Random(seed))[0])):
            assert (node.letters, node.linked, node.links) == plain(node)


def test_hostile_pages_take_little_time():
    n, began = 20_000, time.time()
    for html in ("<div>" * n + "deep", "<a " * n, '<a "' * n + ">", "".join(f"<div><p>Some text, and more {i}" for i in range(n)), "<div>" * n + "</x>" * n, "<script>" + "</script " * n, "<ul><li>a" * n, "<!--" * n, "<a href=x>" * n):
        html_text.extract(html)
    assert time.time() - began < 20


def test_pages_table(spark):
    made = [page(random.Random(seed)) for seed in range(100, 120)]
    pages = spark.createDataFrame([(i, f"u{i}", html) for i, (html, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_pages(pages.withColumn("text", F.lit("clash"))).collect()}
    assert all(got[i].text == "\n".join(blocks) and got[i].n_chars == len(got[i].text) for i, (_, blocks) in enumerate(made))
