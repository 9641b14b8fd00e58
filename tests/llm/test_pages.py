"""Operators on pages."""

import pytest

from strandline.llm.html_text import extracted, main_text
from strandline.llm.url_filter import judged

RULES = {
    "allow": ("org/", "com/fr/"),
    "block": ("example.org/es/", "example.org/en/1", "com/de/"),
}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("only text", "only text"),
        ("<p>a &amp; b&nbsp;c &#x41;<br>d</p>", "a & b c A d"),
        ("<nav><a>x</a><article><p>Hello</p><aside>side</aside><form>f</form></article>", "Hello"),
        ("<article><h1>T</h1><p><b>One<br><p>Two</p></article><footer>f</footer>", "T\n\nOne\n\nTwo"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>body</p></article>", "T\n\nbody"),
        ("<article><p>a</p></article><section class='comments'><article>c</article></section>", "a"),
        ("<div class='ad'>buy</div><main><p>kept</p><script>var a='<p>';</script></main>", "kept"),
        ("<article><p>kept</p><p style='display: none'>not</p><!-- nor <p> --></article>", "kept"),
        ("<![if x]><p>text</p><![endif]>", "text"),
        ("<article><p>a<script>", "a"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_dense_lines_without_article():
    prose = "Long text that is the content of the page and goes on for a while. " * 3
    links = "<ul>" + "<li><a href='x'>Link</a></li>" * 6 + "</ul>"
    page = f"{links}<div><h2>Title</h2><p>{prose}</p><p>Short.</p><p>{prose}</p></div>{links}"
    assert main_text(page) == "\n\n".join(("Title", prose.strip(), "Short.", prose.strip()))


PROSE = [f"Paragraph {i} tells at some length what the page has to say about it. " * 2 for i in range(6)]


def page(article, beside, footer):
    """A page with a menu, an advert, an article with a short paragraph, and a footer."""
    menu = "".join(f"<li><a href='/{i}'>menu {i}</a></li>" for i in range(6))
    body = "<p>Short.</p>".join(f"<p>{text}</p>" for text in PROSE)
    return (
        f"<body><{beside}><ul>{menu}</ul></{beside.split()[0]}><div>Buy it now, cheap.</div>"
        f"<{article}><h1>Title</h1>{body}</{article.split()[0]}><{footer}>&copy; someone</{footer}>"
    )


def test_neutral_names_give_the_same_text():
    wanted = main_text(page("article", "nav class='menu'", "footer"))
    assert wanted == "\n\n".join(("Title", "\n\nShort.\n\n".join(t.strip() for t in PROSE)))
    assert main_text(page("div class='x1'", "div class='x2'", "div")) == wanted
    assert main_text(page("section", "section", "section")) == wanted


@pytest.mark.parametrize("wrapper", ["article", "div class='q'"])
def test_adverts_and_menus_inside_the_article(wrapper):
    plain = page(wrapper, "nav", "footer")
    links = "<div class='z'>" + "<span><a href='x'>Other page</a></span><br>" * 5 + "</div>"
    advert = "<div class='z9'><b>Buy</b> <i>now</i> <a href='x'>here</a></div>"
    for part in (links, advert):
        at = plain.index("<p>Paragraph 3")
        assert main_text(plain[:at] + part + plain[at:]) == main_text(plain)


def test_ratios_choose_the_region(monkeypatch):
    html = page("div", "div", "div")
    wanted = main_text(html)
    monkeypatch.setattr("strandline.llm.html_text._smoothed", lambda ratios: [-x for x in ratios])
    assert main_text(html) != wanted


def test_deeply_nested_markup():
    assert main_text("<div>x" * 200_000).count("x") == 200_000
    assert main_text("<b>" * 200_000 + "text" + "</i>" * 200_000) == "text"
    assert main_text("<ul><li>y" * 100_000).count("y") == 100_000


def test_extracted(spark):
    rows = [(1, "u", "<p>a</p>", 3), (1, "u", "<p>a</p>", 3), (None, None, None, None)]
    rows.append((2, "v", "<article>" + "<p>x</p>" * 20_000, 1))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = sorted(extracted(pages).collect(), key=lambda row: (row.page_id or 0, row.n_chars))
    assert [(row.page_id, row.n_chars) for row in found] == [(None, 0), (1, 1), (1, 1), (2, 59_998)]
    assert found[0].text == "" and found[0].url is None
    assert extracted(pages.limit(0)).count() == 0


def test_judged(spark):
    urls = [
        (1, "https://A.Example.ORG/es/x?y"),
        (2, "http://example.org/en/17"),
        (3, "http://example.org/en/2"),
        (4, "http://notexample.org#f/es/"),
        (5, "http://x.com/fr/a://b"),
        (6, "http://com/de/"),
        (7, "http://x.org"),
        (8, None),
        (9, "no host"),
        (10, "http://x.net/fr/"),
        (10, "http://x.net/fr/"),
        (None, "HTTP://É.com/de"),
    ]
    pages = spark.createDataFrame([(*u, "c") for u in urls], "page_id long, url string, host string")
    rows = judged(pages, **RULES).collect()
    assert len(rows) == len(urls)
    found = {row.page_id: (row.host, row.path, row.rule) for row in rows}
    assert found == {
        1: ("a.example.org", "/es/x", "example.org/es/"),
        2: ("example.org", "/en/17", "example.org/en/1"),
        3: ("example.org", "/en/2", "org/"),
        4: ("notexample.org", "", None),
        5: ("x.com", "/fr/a://b", "com/fr/"),
        6: ("com", "/de/", "com/de/"),
        7: ("x.org", "", None),
        8: ("", "", None),
        9: ("", "", None),
        10: ("x.net", "/fr/", None),
        None: ("É.com", "/de", None),
    }
    for row in rows:
        if row.rule:
            assert row.verdict == ("allow" if row.rule in RULES["allow"] else "block")
        assert row.verdict in ("allow", "block") and 0 <= row.score <= 1


def test_judged_without_labelled_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [row.verdict for row in judged(pages, **RULES).collect()] == ["allow"]
    assert judged(pages.limit(0), **RULES).count() == 0


def test_model_learns_the_rules(spark):
    rows = [(i, f"http://w{i % 7}.x{i}.com/{'fr' if i % 2 else 'de'}/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://h{i}.net/{'fr' if i % 2 else 'de'}/{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = judged(pages, **RULES).filter("page_id >= 1000").collect()
    right = sum((row.verdict == "allow") == bool(row.page_id % 2) for row in found)
    assert right >= 38
