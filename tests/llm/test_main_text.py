"""Wrapper induction by itself: tree matching against brute force, and pages that say nothing of what their parts are."""

from __future__ import annotations

import functools
import random

from gridloom.llm import main_text
from tests.llm.conftest import prose


def tree(r: random.Random, depth: int) -> tuple:
    return (r.choice("ab" if depth < 3 else "r"), tuple(tree(r, depth - 1) for _ in range(r.randint(0, 3))) if depth else ())


@functools.cache
def most(a: tuple, b: tuple) -> int:
    """The largest matching that keeps roots, parents and order, by trying all choices."""

    @functools.cache
    def rows(x: tuple, y: tuple) -> int:
        if not x or not y:
            return 0
        return max(rows(x[1:], y), rows(x, y[1:]), most(x[0], y[0]) + rows(x[1:], y[1:]))

    return 0 if a[0] != b[0] else 1 + rows(a[1], b[1])


def preorder(t: tuple) -> list[tuple]:
    return [t, *(y for k in t[1] for y in preorder(k))]


def test_tree_matching_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        a, b = tree(r, 3), tree(r, 3)
        score, pairs = main_text.align(a, b)
        assert score == most(a, b) == len(pairs)
        one, other = preorder(a), preorder(b)
        assert all(one[i][0] == other[j][0] for i, j in pairs)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert [j for _, j in sorted(pairs)] == sorted(j for _, j in pairs)  # order is kept


def page(i: int) -> str:
    menu = "".join(f"<div><b>{w}</b> and more of it</div>" for w in ("Home", "News", "Contact"))
    own = "".join(f"<p>{prose(100 * i + k, 30).replace(chr(10), ' ')}</p>" for k in range(2 + i % 3))
    return f"<html><body><div><section>{menu}</section><section><div>Read on this site every day.</div>{own}<div><b>All</b> the rights are ours and ours alone, wherever you read this.</div></section></div></body></html>"


def test_templates_of_pages_without_marks(spark):
    """No element, class or id names a part; the least page is an error page of another layout, and a third of the host's pages are copies of one."""
    rows = [(0, "http://h/0", "<html><body>gone</body></html>"), (1, "http://h/1", None)] + [(i, f"http://h/{i}", page(i)) for i in range(2, 20)] + [(100 + i, f"http://h/c{i}", page(5)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in main_text.main_text(df).collect()}
    for i in [*range(2, 20), *range(100, 109)]:
        k = i if i < 100 else 5
        assert got[i].split("\n") == [prose(100 * k + j, 30).replace("\n", " ") for j in range(2 + k % 3)], i
    assert got[0] == "gone" and got[1] == ""
    known = main_text.templates(df.selectExpr("page_id", "html", "'h' as host")).collect()
    assert len(known) == 1 and len(known[0]["nodes"]) >= 3  # the decisions are the template's
    alone = df.where("page_id in (2, 3)")
    assert all("Read on" in r["text"] and "rights" in r["text"] for r in main_text.main_text(alone).collect())  # too few pages to learn from


def test_tree_matching_in_halves(monkeypatch):
    monkeypatch.setattr(main_text, "CELLS", 2)
    main_text.align.cache_clear()
    r = random.Random(5)
    for _ in range(200):
        a, b = ("r", tuple(tree(r, 1) for _ in range(r.randint(0, 7)))), ("r", tuple(tree(r, 1) for _ in range(r.randint(0, 7))))
        score, pairs = main_text.align(a, b)
        assert score == most(a, b) == len(pairs)
        assert all(p < q and s < t for (p, s), (q, t) in zip(pairs[1:], pairs[2:]))
    main_text.align.cache_clear()


def test_pages_of_very_many_siblings():
    """50,000 siblings that don't fold, against 50,000 others: memory grows with the siblings."""
    import time

    r = random.Random(6)
    pages = ["<body><div class=menu>m</div>" + "".join(f"<{(t := r.choice(['h2', 'p', 'ul', 'pre']))}>{i}</{t}>" for i in range(50_000)) + "</body>" for _ in range(2)]
    began = time.time()
    (one, _), (other, _) = (main_text.outline(main_text.parse(p)) for p in pages)
    score, pairs = main_text.align(one, other)
    assert score == len(pairs) > 20_000 and time.time() - began < 60
    assert len(main_text.extract(pages[0], None, (), ()).split("\n")) == 50_000


def test_headers_and_doubtful_words():
    def text(page: str) -> str:
        return main_text.extract(page, None, (), ())

    assert text("<body><header>Site name and tag line</header><p>One two three.</p></body>") == "One two three."
    assert text("<article><header><a>Home</a> <a>About</a></header><p>Text.</p></article>") == "Text."
    assert text("<article><header><h1>Title</h1><p>by me</p><h2>Under <b>it</b></h2></header><p>Text.</p></article>") == "Title\nUnder it\nText."
    kept = "".join(f"<section class='{c}'><p>{c} text</p></section>" for c in ("social-history", "skip", "search-methods", "related")) + "<p hidden>kept too</p>"
    assert text(f"<article><p>A.</p>{kept}<div class='comments'>no</div><div class='ad'>no</div></article>") == "A.\nsocial-history text\nskip text\nsearch-methods text\nrelated text\nkept too"
    assert text("<body><div class='social-links'>no</div><div class='search'>no</div><div><p>Some text that is long.</p></div></body>") == "Some text that is long."
