import html as htmllib
import re

import numpy as np
import pytest

from motiflake.llm import html


def article(page):
    """The generator's pages: what is between the article tags, by blocks."""
    m = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    blocks = [re.sub(r"\s+", " ", htmllib.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", m[1])]
    return "\n\n".join(x for x in blocks if x)


def test_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = html.query(spark, sf).collect()
    assert sorted(r.page_id for r in found) == sorted(pages)
    for r in found:
        assert r.url == pages[r.page_id].url and r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text)
    assert sorted(found) == sorted(html.query(spark, sf).collect())


def test_odd_pages(spark, tmp_path):
    rows = [(1, None, None), (2, "http://a/x", ""), (2, "http://a/x", ""), (None, "no scheme", "<p>a &lt; b"), (4, "http://a/y", "x" * 200_000), (5, "http://a/z", "<p>" * 20_000 + "deep"), (6, "http://A/z?q#f", "<article><p>one\t two<br>three</article>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.text) for r in html.query(spark, str(tmp_path)).collect()}
    assert got == {(1, ""), (2, ""), (None, "a < b"), (4, "x" * 200_000), (5, "deep"), (6, "one two three")}
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html.query(spark, f"{tmp_path}/none").collect() == []


def test_differencing_removes_the_template_of_pages_without_an_article(spark):
    page = lambda i: f"<body><div>Site name</div><div>Menu one</div><p>Text {i} of its own, long enough to matter.</p><p>More {i} &amp; more.</p><div>Imprint</div>"
    rows = [(i, f"http://h/dir/{i}", page(i)) for i in range(300)] + [(999, "http://other/", page(0))]
    got = {r.page_id: r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text {i} of its own, long enough to matter.\n\nMore {i} & more." for i in range(300))
    assert got[999].startswith("Site name")


def test_shared_lines_of_a_likely_element_go(spark):
    page = lambda i: f"<div>Site</div><div class=content><p>Written by the editors</p><p>Text {i}, which no other page has, at length.</p></div>"
    rows = [(i, f"http://h/dir/{i}", page(i)) for i in range(20)]
    got = html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Text {r.page_id}, which no other page has, at length." and r.n_shared == 2 for r in got)


def test_copies_do_not_erase_each_other(spark):
    page = "<div>Menu</div><p>The very same text under two addresses, whole.</p>"
    rows = [(1, "http://h/a", page), (2, "http://h/a?ref=1", page)]
    assert {r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Menu\n\nThe very same text under two addresses, whole."}


def test_a_long_template_goes_and_copies_stay(spark):
    menu = "<div>Site name and a menu of many words</div><div>Imprint and notices, also long</div>"
    texts = ["Short text a.", "Short text b.", "Short text c.", "Short text c.", "Short text d."]
    rows = [(i, f"http://h/{i}", f"{menu}<p>{t}</p>") for i, t in enumerate(texts)]
    got = html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in sorted(got)] == texts


@pytest.mark.parametrize(
    "page",
    [
        "<div>Site</div><h1 class='entry-title'>Title {0}</h1><div class=text><p>The body {0}, which is the article and longer.</p></div>",
        "<div>Site</div><h1>Title {0}</h1><div class=text><p>The body {0}, which is the article and longer.</p></div><div class=story>Teaser {0}</div>",
    ],
)
def test_a_small_likely_element_does_not_hide_the_article(page):
    a, b = (html.Page((i, ""), "", str(i), html.lines(page.format(i))) for i in (1, 2))
    text, *_ = html.main_text(a, b)
    assert "Title 1" in text and "The body 1, which is the article and longer." in text and "Site" not in text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>m</nav><article><h1>T</h1><p>a</p><aside>s</aside><div class='comments'><article class=comment>c</article></div><p>b</article><footer>f", "T\n\na\n\nb"),
        ("<div class=ad>x<article><p>a</article>", "a"),
        ("<article><script>'</p><p>'</script><style>p{}</style><!-- <p>no</p> --><p>a<b>b</b>c<form><input>q</form>", "abc"),
        ("<article><p class=ad>buy<p>text</article>", "text"),
        ("<header>h</header><main><p>&eacute;&#8364;&amp;lt;</p></main>", "é€&lt;"),
        ("<article><p>a <a href='x>y'>link</a> b</p><p hidden>no</p><p style='display: none'>no</p></article>", "a link b"),
        ('<article><p>a<a href="x>b</p></article>', "ab"),
        ("<div class=wrap><div id=top>Site</div><div class='post-content'><div>one</div><p>two</div><div>Imprint</div></div>", "one\n\ntwo"),
        ("<article><p>a</p><figure><img src=x><figcaption>Caption</figcaption></figure><math><mi>x</mi><mo>=</mo><mn>1</mn></math><noscript>plain</noscript><object>instead</object></article>", "a\n\nCaption\n\nx\n\n=\n\n1\n\nplain\n\ninstead"),
        ("<article><form action=/s/><p>Search terms</p></form><p>Body</p></article>", "Body"),
        ("<article><script src='x'/>alert(1)</script><svg><g class=menu /><text>label</text></svg><p>b</p><div class='menu'/>gone</article>", "label\n\nb"),
        ("<article><p>A</p></article><p>Second part</p>", "A\n\nSecond part"),
        ("<article><p>The article, longer than the rest</p></article><p>Else</p>", "The article, longer than the rest"),
        ("<article><p>a</p><div class=related><div>b</div></div><span class=share>c</span><p>d</p></article>", "a\n\nd"),
        ("<article class='social-science'><p>text</p><div class='social'>share</div></article>", "text"),
    ],
)
def test_markup(page, text):
    parsed = html.Page((1, ""), "", "", html.lines(page))
    assert html.main_text(parsed, None)[0] == text


def site(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_lines_within_articles_go(spark):
    """Edges of an article that all pages around it have; inner lines stay, and so do blocks of doubtful markup that differ."""
    page = lambda i: f"<article><p>Home and news</p><h1>Title {i}</h1><p>Text {i}, long enough to be most of the page by far.</p><p>A line that all have, within.</p><p>End of text {i}.</p><div class=share>Share this</div><div class=related>Part {i} of the text</div><p>All rights reserved</p></article><p>Site note</p><p>Appendix {i}</p>"
    got = html.extract(spark, site(spark, [(i, f"http://h/dir/{i}", page(i)) for i in range(50)])).collect()
    for r in got:
        i = r.page_id
        assert r.text.split("\n\n") == [f"Title {i}", f"Text {i}, long enough to be most of the page by far.", "A line that all have, within.", f"End of text {i}.", f"Part {i} of the text", f"Appendix {i}"]
        assert r.n_decided == 3


def test_versions_of_an_article_keep_their_lines(spark):
    """Pages whose articles share most of their lines are copies; those that share a passage with some pages only keep it."""
    body = [f"Paragraph {k} of the same article, of some length." for k in range(8)]
    versions = [(i, f"http://h/a/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in [*body, f"Edit {i}"]) + "</article>") for i in range(4)]
    quotes = [(10 + i, f"http://q/{i}", f"<article><p>Quoted {i // 2}</p><p>Text {i} of its own, which is longer than that.</p></article>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark, site(spark, versions + quotes)).collect()}
    assert all(got[i] == "\n\n".join([*body, f"Edit {i}"]) for i in range(4))
    assert all(got[10 + i] == f"Quoted {i // 2}\n\nText {i} of its own, which is longer than that." for i in range(6))


def test_pages_of_sf01_are_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    found = html.query(spark, "/root/testdata/sf0.1").collect()
    assert len(found) == len(pages) and all(r.text == article(pages[r.page_id]) for r in found)


def test_unrelated_pages_change_no_text(spark, tmp_path):
    """Neighbours are found across cuts, whatever their number: brute force over the sorted pages says the same."""
    rng = np.random.default_rng(7)
    pick = lambda i: f"<div>Site</div><div>Menu {rng.integers(2)}</div><p>Text {i}</p><p>Line {rng.integers(3)}</p><p>Line {rng.integers(3)}</p><div>End</div>"
    rows = [(i, f"http://h{i % 3}/{'ab'[i % 2]}/{i}", pick(i)) for i in range(400)]
    other = [(1000 + i, f"http://z{i % 5}/{i}", pick(i)) for i in range(777)]
    few = {r.page_id: (r.text, r.n_shared) for r in html.extract(spark, site(spark, rows)).collect()}
    more = {r.page_id: (r.text, r.n_shared) for r in html.extract(spark, site(spark, rows + other)).collect()}
    assert len(few) == 400 and all(more[i] == x for i, x in few.items())
    parsed = [html.Page((i, u), u.split("/")[2], u.split("/", 3)[3], html.lines(h)) for i, u, h in sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3], r[0]))]
    for k, p in enumerate(parsed):
        near = {d: parsed[k + d] if 0 <= k + d < len(parsed) and parsed[k + d].group == p.group else None for d in (-2, -1, 1, 2)}
        same = lambda q: next((n for n, (a, b) in enumerate(zip(q.path, p.path, strict=False)) if a != b), min(len(q.path), len(p.path)))  # noqa: E731, B023
        d = max((d for d in (1, -1) if near[d]), key=lambda d: same(near[d]), default=None)  # noqa: B023
        other_ = next((near[e] for e in (-1, 1, -2, 2) if near[e] and e != d), None)
        lcs = lambda q: table(p.texts(), q.texts())  # noqa: E731, B023
        taken = lcs(near[d]) if d else set()
        chars = lambda at: sum(len(p.texts()[i]) for i in at)  # noqa: E731, B023
        if taken and other_ and chars(taken) > 0.5 * chars(range(len(p.lines))):
            taken &= lcs(other_)
            most = 0.9
        else:
            most = 0.5
        taken = taken if chars(taken) <= most * chars(range(len(p.lines))) else set()
        assert few[p.row[0]][0] == "\n\n".join(t for i, t in enumerate(p.texts()) if i not in taken), p


def table(a, b):
    """Positions of a longest common subsequence in `a`, by the whole table; of equal ones, as the operator has it."""
    n, m, lead = len(a), len(b), 0
    while lead < min(n, m) and a[lead] == b[lead]:
        lead += 1
    while n > lead and m > lead and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = {*range(lead), *range(n, len(a))}
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(lead, n):
        for j in range(lead, m):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    i, j = n, m
    while i > lead and j > lead:
        if t[i - 1][j] == t[i][j]:
            i -= 1
        elif t[i][j - 1] == t[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(i)
    return out


def test_pages_that_repeat_whole_spread_over_pieces(spark):
    rows = [(None, None, "<p>the same page</p>")] * 3000 + [(i, f"http://h/{i}", f"<p>Text {i}</p>") for i in range(500)]
    got = html.extract(spark, site(spark, rows)).collect()
    assert len(got) == 3500 and sum(r.text == "the same page" for r in got) == 3000


def test_deep_markup_is_read_in_linear_time():
    import time

    def took(n):
        page = "<div class=ad>x<article><p>a" * n
        began = time.process_time()
        html.lines(page)
        return time.process_time() - began

    took(2_000)
    assert took(40_000) < 40 * took(4_000) + 0.5


@pytest.mark.parametrize("bits", [html.TABLE_BITS, 40, 1])
def test_shared_is_a_longest_common_subsequence(bits, monkeypatch):
    monkeypatch.setattr(html, "TABLE_BITS", bits)
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 24)).tolist() for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = [a[i] for i in sorted(html.shared(a, b))]
        rest = iter(b)
        assert len(got) == table[-1][-1] and all(x in rest for x in got)


def test_many_lines_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    a, b = ([f"line {x}" for x in rng.integers(0, 30_000, 40_000)] for _ in range(2))
    tracemalloc.start()
    got = html.shared(a, b)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and len(got) > 300
    tracemalloc.stop()
