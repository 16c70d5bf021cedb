"""Main texts of hand-written layouts, exactly; the model learns from the given pages."""

import duckdb
import pytest

from termloom.llm import html_extract
from termloom.llm.common import ready

SF = "/root/testdata/sf0.001"
P = "The quick brown fox jumps over the lazy dog and then some more words follow in this sentence."
PROSE = f"<h1>A title</h1><p>{P}</p><p>{P} {P}</p><p>{P}</p>"
LINES = ["A title", P, f"{P} {P}", P]
LINKS = '<a href="/a">Home</a> <a href="/b">About</a> <a href="/c">Contact</a>'
BODY = {
    "unknown classes": (f'<div class="zq1">{LINKS}</div><div class="zq2">{PROSE}</div><div class="zq3">Copyright 2024</div>', LINES),
    "bare divs": (f"<div>{LINKS}</div><div>{PROSE}</div><div>Copyright 2024</div>", LINES),
    "prose": (f'<nav>{LINKS}</nav><div class="prose">{PROSE}</div><footer>foot</footer>', LINES),
    "paragraphs alone": (f"<p>{P}</p><p>{P}</p><p>{P}</p>", [P] * 3),
    "table": (f"<main><h1>A title</h1><table><tr><td>{P}</td><td>{P}</td></tr></table></main><footer><p>c</p></footer>", ["A title", P, P]),
    "aside in the article": (f"<article>{PROSE}<aside>Subscribe to our newsletter</aside><p>{P}</p></article>", [*LINES, P]),
    "related links in the article": (f'<article><h1>T</h1><aside><h3>Related</h3><ul><li><a href="x">one</a></li></ul></aside><p>{P}</p></article>', ["T", P]),
    "advert": (f'<article><p>{P}</p><div class="ad">Buy now</div><p>{P}</p></article>', [P, P]),
    "comments": (f'<article>{PROSE}</article><div class="comments"><h3>2 comments</h3><p>{P}</p><p>{P}</p></div>', LINES),
    "button": (f"<article>{PROSE}<button>Share</button><p>{P}</p></article>", [*LINES, P]),
    "form in the article": (f"<article>{PROSE}<form><label>Email</label><input><button>Go</button></form><p>{P}</p></article>", [*LINES, P]),
    "open select": (f"<article><p>{P}</p><div><select><option>a<option>b</div><p>{P}</p></article>", [P, P]),
    "open object": (f'<article><p>{P}</p><div><object data="x"></div><p>{P}</p></article>', [P, P]),
    "closed object": (f"<article><p>{P}</p><object><div>fallback</div></object><p>{P}</p></article>", [P, P]),
    "references and blanks": ("<article><h1>A &amp; B</h1><p>x&nbsp;y  <b>z</b>\n\tw" + f" {P}</p></article>", ["A & B", f"x y z w {P}"]),
}


@pytest.fixture(scope="module")
def model():
    return html_extract.learn(sorted(h for (h,) in duckdb.sql(f"select distinct html from '{SF}/pages.parquet'").fetchall()))


@pytest.mark.parametrize("name", BODY)
def test_layouts(model, name):
    body, want = BODY[name]
    assert html_extract.main_text(f"<html><body>{body}</body></html>", model).split("\n") == want


def test_an_open_head_ends_at_the_text(model):
    assert html_extract.main_text(f"<html><head><title>x</title><p>{P}</p><p>{P}</p>", model) == f"{P}\n{P}"
    assert html_extract.main_text(f'<html><head><meta charset="x"><style>p{{}}</style><article>{PROSE}</article></html>', model).split("\n") == LINES
    assert html_extract.main_text(f"<html><head><title>x</title></head><body><article><p>{P}</p></article></body></html>", model) == P


def test_given_pages_against_their_articles(spark):
    """Gold from the markup itself: the blocks of the article, without what a class or element marks as no part of it."""
    ready(spark)
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_extract.op1(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    seen = 0
    for r in rows:
        page = html_extract.Page(r["html"])
        inside = [t == "article" for t in page.tag]
        apart = [t in ("nav", "aside", "form", "footer") or any(w in html_extract.CHROME_WORDS for w in words) for t, words in zip(page.tag, page.tokens)]
        for i in range(1, len(page.tag)):
            inside[i] = inside[i] or inside[page.parent[i]]
            apart[i] = apart[i] or apart[page.parent[i]]
        if any(inside):
            assert got[r["page_id"]] == "\n".join(t for node, t in page.blocks if inside[node] and not apart[node])
            seen += 1
    assert seen >= 0.9 * len(rows)


def test_odd_pages(spark):
    ready(spark)
    long = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, 1, "x"), (2, None, "", 1, "x"), (3, "u", long, 1, "x"), (3, "u", long, 1, "x"), (None, "u", f"<p>{P}", 1, "x")]
    got = html_extract.op1(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, len(P)), (1, 0), (2, 0)] + [(3, 20_000 * (len(P) + 1) - 1)] * 2
