import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from linkspan.llm import html_extraction as h

PAGE = "page_id long, url string, html string"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 20))] for _ in range(2))
        mask = h.shared(a, b)
        kept = [x for x, m in zip(a, mask, strict=True) if m]
        it = iter(b)
        assert len(kept) == lcs(a, b) and all(x in it for x in kept)


def test_alignment_of_long_pages():
    a = ["same"] * 20_000 + ["x"]
    assert sum(h.shared(a, ["y"] + ["same"] * 15_000)) == 15_000


def texts(page):
    return [t for t, z, _ in h.parse(page) if z == h.CONTENT]


def test_parse():
    assert texts("<article><h1>T &amp; U&am</h1><p>a\n <b>b</b>c&nbsp;d<br>e<p>f &lt;x&gt;</article><footer>no</footer>") == ["T & U&am", "a bc d e", "f <x>"]
    assert texts("<main>one<nav><ul><li>m</ul></nav>two<div class='share-links'>no</div><div class='post-share'>no</div><div class='sharecropper'>yes</div><form>f</form>three<aside>x</aside></main>") == ["one", "two", "yes", "three"]
    assert texts('<article>a<script>var t="</p>";</script><style>p{}</style><!-- c <p> -->b<section id="comments"><p>no</p></section>c</article>') == ["ab", "c"]
    assert texts("<article>a <b class=ad>no</b> b<p class='notice'>no<p>c") == ["a", "b", "c"]
    assert h.parse(None) == [] and h.parse("") == [] and h.parse("<p") == [] and texts("<article>1 < 2 & 3 <4</article>") == ["1 < 2 & 3 <4"]


def run(spark, rows):
    return {r.page_id: r for r in h.extract(spark.createDataFrame(rows, PAGE)).collect()}


def test_differencing_removes_the_template_of_pages_without_an_article(spark):
    page = "<body><div>Top line</div><p>{}</p><div>Bottom line</div></body>"
    got = run(spark, [(1, "http://a.com/x/1", page.format("first")), (2, "http://a.com/x/2", page.format("second")), (3, "http://b.com/x/3", page.format("alone"))])
    assert (got[1].text, got[2].text) == ("first", "second") and got[3].text == "Top line\nalone\nBottom line"


ARTICLE = "<article><h1>{0} head</h1><p>{0} one</p><p>said by all</p><p>{0} two</p></article>"
DIVS = "<div id=c7><h1>{0} head</h1><p>{0} one</p><p>{0} two</p></div>"
FRAME = "<body><div id=m1><p>Home</p><p>News</p></div><div class=story><p>Teaser of the day</p></div>{0}<div id=f9>All rights reserved</div></body>"


class Expected(HTMLParser):
    """The text of the article or of the div c7, by another parser."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.lines = 0, [""]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article" or ("id", "c7") in attrs
        self.lines.append("")

    def handle_endtag(self, tag):
        self.inside -= tag in ("article", "div") and self.inside > 0
        self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def expected(page):
    return "\n".join(x for x in Expected(page).lines if x)


def hosts():
    """Pages with and without article elements, and hosts that hold copies of pages and of articles."""
    rows = []
    for i in range(40):
        rows.append((i, f"http://art.com/s{i % 3}/{i}", FRAME.format(ARTICLE.format(f"a{i}"))))
        rows.append((100 + i, f"http://div.com/s{i % 3}/{i}", FRAME.format(DIVS.format(f"d{i}"))))
        rows.append((200 + i, f"http://div.com/copies/{i}", FRAME.format(DIVS.format("same"))))
        rows.append((300 + i, f"http://art.com/copies/{i}", FRAME.format(ARTICLE.format("same"))))
    return rows


def test_the_difference_finds_the_text(spark, monkeypatch):
    rows = hosts()
    got = run(spark, rows)
    assert {i: got[i].text for i, *_ in rows} == {i: expected(page) for i, _, page in rows}
    # without the marks of the alignment the template stays on every page
    monkeypatch.setattr(h, "_aligned", lambda pairs, f=h._aligned: f(pairs).withColumn("common", F.transform("common", lambda _: F.lit(False))))
    blind = run(spark, rows)
    assert all("Teaser" in blind[i].text and blind[i].text != got[i].text for i, *_ in rows)


def test_marks_by_a_shuffle(spark, monkeypatch):
    rows = hosts()
    here = run(spark, rows)
    monkeypatch.setattr(h, "BROADCAST_LINES", 0)
    there = run(spark, rows)
    assert here == there


def test_given_pages_agree_with_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: " ".join(r.text.split()) for r in h.extract(pages).collect()}
    for r in pages.collect():
        e = Expected(re.sub(r"(?s)<script>.*?</script>|<style>.*?</style>|<title>.*?</title>|<nav>.*?</nav>|<footer>.*", "", r.html))
        assert got[r.page_id] == " ".join(" ".join(e.lines).split()), r.page_id


def test_clashing_names(spark):
    rows = spark.createDataFrame(hosts(), PAGE)
    extra = rows.select("*", *(F.lit("x").alias(n) for n in ("uid", "host", "path", "hashes", "digest", "near", "own", "common", "text", "n_lines")))
    assert sorted(h.extract(extra).collect()) == sorted(h.extract(rows).collect())


def test_a_changing_scrap_beside_a_copied_article(spark):
    page = "<div>{}</div><article><h1>Head</h1><p>A long enough paragraph</p></article>"
    got = run(spark, [(i, f"http://a.com/{i}", page.format(f"scrap {i}")) for i in range(4)])
    assert all(r.text == f"scrap {i}\nHead\nA long enough paragraph" for i, r in got.items())


def test_copies_of_an_article_stay(spark):
    page = "<nav><a>Home</a></nav><article><p>copy</p></article><footer>f{}</footer>"
    got = run(spark, [(1, "http://a.com/1", page.format(1)), (2, "http://a.com/2", page.format(1)), (None, None, page.format(3))])
    assert {r.text for r in got.values()} == {"copy"} and got[None].n_chars == 4


def test_nearest_by_path(spark):
    rows = [(i, f"http://h.com{p}", "x") for i, p in enumerate(["/a/1", "/a/2", "/b/c/1", "/b/c/2", "/b/d"])]
    keys = spark.createDataFrame([(i, "h.com", u[12:]) for i, u, _ in rows] + [(9, "other", "/a/1"), (8, "", "")], "uid long, host string, path string")
    got = {r.uid: r.near for r in h.neighbours(keys).collect()}
    assert got == {0: 1, 1: 0, 2: 3, 3: 2, 4: 3}


def test_edges(spark):
    got = run(spark, [(1, "no url", None), (2, "http://a.com", ""), (2, "http://a.com", "<p>é😀"), (3, "://", "<article>" + "<p>line</p>" * 5000 + "</article>")])
    assert got[1].text == "" and got[1].n_chars == 0 and got[3].text.count("\n") == 4999
    assert h.extract(spark.createDataFrame([], PAGE)).count() == 0
