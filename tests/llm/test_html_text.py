import pytest

from tessera.llm.html_text import extract

BODY = "<p>First, of several, words that make a good long paragraph.</p><p>Second, with <a href=x>one link</a> in it.</p>"
TEXT = "First, of several, words that make a good long paragraph.\nSecond, with one link in it."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<nav>a, b, c</nav><script>x</script>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a b<p>c\n d", "a b\nc d"),
        (f"<body><nav><a href=x>menu</a></nav><article><h1>T</h1>{BODY}</article><footer>f</footer></body>", f"T\n{TEXT}"),
        (f"<div class='sidebar'>x, y, z</div><div id=content>{BODY}</div><div id='comments'><p>I say, no, no, no, no, no, never, ever</p></div>", TEXT),
        (f"<div class=page><div class='cookie-notice'>We use cookies, yes</div><div class=post>{BODY}<form>f</form><aside>s</aside></div></div>", TEXT),
        (f"<article>{BODY}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", TEXT),
        (f"<article>{BODY}<ul><li>one<li>two</ul><blockquote>q</blockquote></article>", f"{TEXT}\none\ntwo\nq"),
        ("<article><p><b>Bold start.<br><p>Next &lt;one&gt; &#233;&nbsp;x</article>", "Bold start.\nNext <one> é x"),
        (f"<article>{BODY}<!-- no <p>comment</p> --><style>p{{}}</style><div style='display: none'>gone</div></article>", TEXT),
        ("<article>" + "<p>tiny</p>" * 3 + "</article><div class=ad><p>Buy, buy, buy, all of this, now, at once, please</p></div>", "tiny\ntiny\ntiny"),
        ("<div><div><p>A long paragraph with, commas, and words enough to count.</p></div><div><p>Second section, with plenty of words, and more, kept.</p></div></div>", "A long paragraph with, commas, and words enough to count.\nSecond section, with plenty of words, and more, kept."),
        ("<p>unclosed <b>bold <i>both", "unclosed bold both"),
        ("<div" + " a" * 10, "<div" + " a" * 10),
    ],
)
def test_extract(html, text):
    assert extract(html) == text


def test_deep_and_long():
    assert extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert extract("<article>" + "<p>word word</p>" * 5000 + "</article>").count("\n") == 4999
