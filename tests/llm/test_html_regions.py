"""Main text: precedence of content elements, unclosed and deep elements, and the scan against all spans."""

import random
import time

from kgframe.llm import html

WEIGHTS = {("word", "p"): 1.5, ("word", "li"): -1.5, ("word", "a"): -2.0, ("tag", "p"): -0.1, ("tag", "li"): -2.0}


def words(n, name="w"):
    return " ".join(f"{name}{i}" for i in range(n))


def text(page):
    return html.main_text(page, WEIGHTS)


def test_article_before_longer_comments():
    page = f"<body><article><p>{words(60)}</p></article><section><h2>Comments</h2><p>{words(90, 'c')}</p></section></body>"
    assert text(page) == words(60)
    assert text(page.replace("<h2>Comments</h2>", "<h2>Talk</h2>")) == words(60)


def test_comments_in_the_article():
    page = f'<article><p>{words(30)}</p><article class="comment"><p>{words(9, "c")}</p></article><p>{words(40, "z")}</p></article>'
    assert text(page) == f"{words(30)} {words(40, 'z')}"
    page = f"<main><p>{words(30)}</p><section><h3>12 Comments</h3><p>{words(90, 'c')}</p></section></main>"
    assert text(page) == words(30)
    page = f"<main><h2>Comments on Newton</h2><p>{words(30)}</p></main>"
    assert text(page) == f"Comments on Newton {words(30)}"


def test_all_of_main():
    page = f"<body><nav>{words(9, 'n')}</nav><main><h1>The title</h1><article><p>{words(50)}</p></article><p>{words(30, 'z')}</p></main></body>"
    assert text(page) == f"The title {words(50)} {words(30, 'z')}"
    page = f"<main><article><p>{words(60)}</p></article><article><p>{words(50, 'z')}</p></article></main>"
    assert text(page) == f"{words(60)} {words(50, 'z')}"


def test_unclosed_elements():
    article = f"<article><p>{words(40)}</p></article>"
    assert text(f"<body><nav><ul><li>menu<li>more</ul>{article}</body>") == words(40)
    assert text(f"<body><aside><div>{article}") == words(40)
    assert text(f"<body><article><p>{words(40)}<div>{words(5, 'd')}</body>") == f"{words(40)} {words(5, 'd')}"
    assert text(f"<body><nav><ul><li>menu</ul></nav><div><p>{words(40)}</div><footer>end") == words(40)


def test_deep_and_long_pages():
    began = time.monotonic()
    deep = "<div>" * 200_000 + f"<article><p>{words(20)}</p></article>" + "</div>" * 200_000
    assert text(deep) == words(20)
    assert text("<div><span>" * 100_000 + "</b></i>" * 100_000) == ""
    assert text('<a href="x' * 50_000) == ""
    long = f"<article>{'<p>some words here</p>' * 100_000}</article>"
    assert len(text(long).split()) == 300_000
    assert time.monotonic() - began < 30


def test_scan_against_all_spans():
    draw = random.Random(7)
    for _ in range(500):
        scores = [draw.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(draw.randint(0, 14))]
        best, start, end = html.best_region(scores)
        assert best == max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[start:end]) == best


def test_region_of_a_page_is_the_best_of_all():
    page = f"<body><ul>{'<li>menu entry</li>' * 5}</ul><p>{words(7)}</p><ul><li>one</li></ul><p>{words(12, 'z')}</p><ul>{'<li>last entry</li>' * 5}</ul></body>"
    scores = html.scored(list(html.pieces(page)), WEIGHTS)
    best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    assert html.best_region(scores)[0] == best > 0
    assert text(page) == f"{words(7)} one {words(12, 'z')}"
