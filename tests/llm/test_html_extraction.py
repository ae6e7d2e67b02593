"""Lines of pages, alignments against brute force, and pairing of pages without a marked main part."""

from __future__ import annotations

import random
import re

import pytest

from spanmill.llm import html_extraction as he

SCHEMA = "page_id bigint, url string, html string, text string, lines string, row string"


def text_of_page(page: str) -> str:
    main, free, marked = he.lines(page)
    return "\n".join(main if marked else free)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<article><h1>T &amp; U</h1><p>a\n  b<br>c</p><p>d &#233;&nbsp;e</p></article>", "T & U\na b c\nd é e"),
        ("<nav>n</nav><article><p><b>one.<br><p>two</p></article><footer>f</footer>", "one.\ntwo"),
        ('<script>var t="</p><article>x</article>";</script><main>m</main>', "m"),
        ('<article>a<div class="x ad-box"><div>b</div>c</div>d<aside>e</aside><form>f</form></article>', "a\nd"),
        ('<article>a<section id="comments"><p>c<p>d</section><p>e</article>tail', "a\ne"),
        ("<div role=main>m<header>h</header></div>x", "m"),
        ("<p>a < b and 3<4 &lt;i&gt;</p><!-- <p>no</p> -->y", "a < b and 3<4 <i>\ny"),
        ("<article><p>cut off in a ta", "cut off in a ta"),
        ("<article>x<p class=", "x"),
        ('<article>p<img class="ad">q<a class="share">s</a>r</article>', "p q r".replace(" ", "") if False else "pq\nr"),
        ("<ARTICLE><P>Up</P></ARTICLE><style>p{}", "Up"),
        ("just text", "just text"),
    ],
)
def test_lines(page, text):
    assert text_of_page(page) == text


def common(a: list, b: list) -> int:
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


@pytest.mark.parametrize("held", [0, he.HELD])
def test_alignment_is_longest(monkeypatch, held):
    monkeypatch.setattr(he, "HELD", held)
    draw = random.Random(1)
    for _ in range(400):
        a, b = (draw.choices("abcd", k=draw.randrange(14)) for _ in range(2))
        found = sorted(he.shared(a, b))
        assert len(found) == common(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in found)  # in order


def test_pages_without_marks_lose_what_the_nearest_page_shares(spark):
    top, end = "<div>Our site</div>", "<div>All rights</div>"
    rows = [(k, f"http://h.example/a/{k:02d}?q", f"{top}<p>own {k}</p><p>Our site</p>{end}", "", "", "") for k in range(30)]
    rows += [(100, "http://alone.example/x", f"{top}<p>z</p>", "", "", ""), (101, None, "<p>n</p>", "", "", ""), (102, "http://h.example/zzzz/other", f"{end}<p>w</p>", "", "", "")]
    rows += [(103, "http://h.example/a/00?q", None, "", "", ""), (104, "bad url", "", "", "", ""), (105, "http://h.example/b", "<article>Our site</article>", "", "", "")]
    rows += [rows[0]]
    found = he.main_text(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == len(rows)
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert [texts[k] for k in range(1, 30)] == [f"own {k}" for k in range(1, 30)]
    assert texts[100] == "Our site\nz" and texts[102] == "w" and texts[103] == "" and texts[104] == "" and texts[105] == "Our site"
    assert he.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_copies_of_an_article_are_no_partners(spark):
    def article(k: int) -> list[str]:
        return [f"Sentence {n} of article {k} goes on for some words, as text does." for n in range(20)]

    def page(k: int, *more: str) -> str:
        return "".join(f"<p>{x}</p>" for x in ("Our site", *article(k), *more, "All rights"))

    rows = [(k, f"http://h.example/{k // 4:02d}/{k % 4}", page(k // 4, f"Printed {1 + k % 4} May"), "", "", "") for k in range(40)]
    rows += [(100 + k, f"http://one.example/{k}", page(77, f"Printed {k}"), "", "", "") for k in range(300)]  # one article alone on its host
    rows += [(500, "http://h.example/03/1x", page(3, "Printed 2 May"), "", "", "")]
    found = {r["page_id"]: r["text"] for r in he.main_text(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    for k in range(40):
        assert found[k].split("\n") in ([*article(k // 4), f"Printed {1 + k % 4} May"], article(k // 4))
    assert found[500].split("\n")[:20] == article(3)
    assert all(found[100 + k].split("\n") == ["Our site", *article(77), f"Printed {k}", "All rights"] for k in range(300))


def test_a_page_of_many_megabytes(spark):
    rows = [(k, f"http://h.example/{k}", "<div>Our site</div>" + "".join(f"<p>line {k} {n}</p>" for n in range(60_000 if k == 1 else 5)), "", "", "") for k in range(3)]
    found = {r["page_id"]: r["text"] for r in he.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].split("\n") == [f"line 1 {n}" for n in range(60_000)] and found[0].startswith("line 0 0")


def test_query_gives_the_article_of_every_page(spark):
    from spanmill.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_html_extraction"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in rows:
        want = [" ".join(x.split()) for x in docs[int(re.search(r"/\w\w/(\d+)", r["url"])[1])].split("\n") if x.split()]
        title, *own = r["text"].split("\n")
        assert own == want and " ".join(" ".join(want).split()).startswith(title.rstrip("&")[:40])
        assert r["n_chars"] == len(r["text"])


def test_pages_with_marks_are_differenced_too(spark):
    def page(k: int) -> str:
        return f"<div>Our site</div><article><p>own {k}</p><p>Refrain</p></article><div>tail {k}</div>"

    rows = [(k, f"http://h.example/{k:02d}", page(k), "", "", "") for k in range(12)] + [(50, "http://h.example/99", "<p>Our site</p><p>bare</p>", "", "", "")]
    found = {r["page_id"]: r for r in he.compared(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for k in range(12):  # the top line and the refrain are shared; the mark keeps the refrain, and takes the tail away
        assert (found[k]["text"], found[k]["n_shared"], found[k]["n_kept"]) == (f"own {k}\nRefrain", 2, 1)
    assert (found[50]["text"], found[50]["n_shared"], found[50]["n_kept"]) == ("Our site\nbare", 0, 0)
