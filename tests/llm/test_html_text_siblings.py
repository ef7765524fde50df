import pytest

from tessera.llm.html_text import extract

MANY = "".join(f"<p>Paragraph {i}, of several, with words that make a good long paragraph, and more of them.</p>" for i in range(8))
TEXT = "\n".join(f"Paragraph {i}, of several, with words that make a good long paragraph, and more of them." for i in range(8))
LEAD = "A lead of some length that says what the article is about and goes on for more than eighty letters."
END = "An end of some length that says what the article was about and goes on for more than eighty letters."


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<body><h1>T</h1><p>{LEAD}</p><div>{MANY}</div><p>{END}</p></body>", f"T\n{LEAD}\n{TEXT}\n{END}"),
        (f"<body><div>{MANY}</div><div><h2>S</h2><p>A short section.</p></div></body>", f"{TEXT}\nS\nA short section."),
        (f"<body><h1>T</h1><p>{LEAD}</p><div><div>{MANY}</div></div><p>Short end.</p></body>", f"T\n{LEAD}\n{TEXT}\nShort end."),
        (f"<body><div>{MANY}</div><blockquote>short</blockquote><div>{MANY}</div></body>", f"{TEXT}\nshort\n{TEXT}"),
        (f"<body>{LEAD}<div>{MANY}</div></body>", f"{LEAD}\n{TEXT}"),
        (f"<body><nav>x</nav><div>{MANY}</div><p><a href=a>one link of many words in it</a> <a href=b>another link, of many words in it, and so on and on</a></p><div class=footer>{END}</div></body>", TEXT),
    ],
)
def test_parts_beside_the_best_container(html, text):
    assert extract(html) == text
