"""HTML extraction: parsing, pairing by URL and differencing."""

import html as html_lib
import re

from quillstore.llm import html_text


def slow_article(page):
    """The article of a page of the test tables: tags and references gone, blocks joined by one space."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.DOTALL)
    return " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", found.group(1))).split()) if found else ""


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = html_text.extract(pages).collect()
    want = {r.page_id: slow_article(r.html) for r in pages.collect()}
    assert len(out) == len(want)
    for r in out:
        assert re.sub(r"\s", "", r.text) == re.sub(r"\s", "", want[r.page_id])
        assert r.n_chars == len(r.text) and not re.search(r"\s\s|^\s|\s$|[\n\t]", r.text)


def test_lines():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>A<li>B</ul></nav>"
        "<div class='cookie-notice'>We use <b>cookies</b></div><main><h1>Head&nbsp;&amp; shoulders</h1><p>one<br>two  <i>th</i>ree</p>"
        "<form>Name <input></form><section id=comments><p>First!</p></section><p>x &lt; y &#233;</p></main><footer>&copy; me</footer>"
    )
    assert [t for t, kind in html_text.lines_of(page) if kind == html_text.ARTICLE] == ["Head & shoulders", "one", "two three", "x < y é"]
    assert html_text.lines_of(None) == [] and html_text.lines_of("") == []
    assert html_text.lines_of("plain < text <p") == [("plain < text", html_text.OPEN)]
    assert html_text.lines_of("<p class='adult reading'>kept") == [("kept", html_text.OPEN)]


def test_silent_elements_without_an_end_tag():
    def article(inner):
        return [t for t, kind in html_text.lines_of(f"<article><p>one{inner} two</p><p>three</p></article>") if kind == html_text.ARTICLE]

    for inner in ("<svg class='x'/>", "<svg/>", "<math />", "<iframe src='a'/>", "<svg>", "<iframe src=a>", "<svg/><svg><path d='M0'/>gone</svg>", "<iframe src=http://a/>gone</iframe>"):
        assert article(inner) == ["one two", "three"], inner
    assert article("<script/>var a = 1;") == article("<style>p {}") == ["one"]
    assert article("<svg><text>gone</text></svg>") == ["one two", "three"]


def test_shared_lines_is_a_longest_common_subsequence(monkeypatch):
    import random

    rng = random.Random(1)
    for trial in range(300):
        monkeypatch.setattr(html_text, "_CELLS", rng.choice([1, 8, 1 << 18]))
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        found = sorted(html_text.shared_lines(a, b))
        assert len(found) == table[0][0]
        at = 0
        for i in found:
            at = b.index(a[i], at) + 1


def test_differencing_without_articles(spark):
    shell = "<body><div>Home About</div><div>{}</div><div>All rights</div></body>"
    rows = [(i, f"http://a.org/x/{i}?q={i}", shell.format(f"story {i}"), i) for i in range(40)]
    rows += [(90, "http://b.org/", shell.format("alone"), 0), (91, None, None, 0), (92, None, "", 0), (None, "http://c.org/1", shell.format("c1"), 0), (94, "http://c.org/2", shell.format("c2"), 0)]
    rows += [rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    out = {(r.page_id, r.url): r.text for r in html_text.extract(df.repartition(5)).collect()}
    assert all(out[i, f"http://a.org/x/{i}?q={i}"] == f"story {i}" for i in range(40))
    assert out[90, "http://b.org/"] == "Home About alone All rights"
    assert out[91, None] == out[92, None] == ""
    assert out[None, "http://c.org/1"] == "c1" and out[94, "http://c.org/2"] == "c2"
    assert html_text.extract(df).count() == len(rows)
    assert html_text.extract(df.limit(0)).collect() == []


def test_long_pages_align_in_little_memory():
    import tracemalloc

    own, other = list(range(100_000)), [*range(50_000, 100_000), *range(50_000)]
    other[7] = own[60_000] = -1
    tracemalloc.start()
    found = html_text.shared_lines(own, other)
    assert len(found) >= 49_999 - 1 and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_bad_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for bad in ("<a \"'", "<title>", "<p class='", "<a b=\"", "</", "<!--", "<svg>", "<a '\" <b \"'"):
        html_text.lines_of(bad * 60_000)
    assert time.perf_counter() - began < 30
    assert html_text.lines_of("<p title=\"it's>one</p><p>two</p>") == [("one", html_text.OPEN), ("two", html_text.OPEN)]


def test_the_nearest_page_shares_most_of_the_path(spark, monkeypatch):
    """Between two pages with other menus, a page is aligned with the one under the same folder; without differencing menus stay."""
    menu = "<body><div>{}</div><div>{}</div></body>"
    rows = [(1, "http://a.org/x/1", menu.format("Menu X", "x1")), (2, "http://a.org/y/1", menu.format("Menu Y", "y1")), (3, "http://a.org/y/2", menu.format("Menu Y", "y2")), (4, "http://a.org/z/1", menu.format("Menu Z", "z1"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {1: "Menu X x1", 2: "y1", 3: "y2", 4: "Menu Z z1"}
    plain = html_text.neighbours
    monkeypatch.setattr(html_text, "neighbours", lambda pages: plain(pages).where("false"))
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {1: "Menu X x1", 2: "Menu Y y1", 3: "Menu Y y2", 4: "Menu Z z1"}


def test_differencing_decides_on_pages_with_articles(spark, monkeypatch):
    """Teasers and trails that the nearest page shares go from article and main elements; without differencing they stay."""
    teaser = "<article><h3>Fair opens</h3><p>Read on</p></article>"
    shell = "<body><nav>Home</nav><main><div>News &gt; Local</div>{}" + teaser + "<div>Back to top</div></main><footer>F</footer>"
    one, two = (f"<article><h1>{x} things happened</h1><p>Summary</p><p>All of it is told here at length, of {x}.</p></article>" for x in "AB")
    story, other = "A things happened Summary All of it is told here at length, of A.", "B things happened Summary All of it is told here at length, of B."
    rows = [(1, "http://a.org/x/1", shell.format(one)), (2, "http://a.org/x/2", shell.format(two))]
    recipe = "<main><div>Recipes</div><h1>{0} soup for many</h1><p>Ingredients</p><p>Take {0}, and water and salt.</p></main>"  # a shared line between own ones is text
    rows += [(3, "http://b.org/1", recipe.format("leek")), (4, "http://b.org/2", recipe.format("pea"))]
    rows += [(5, "http://c.org/1", shell.format(one)), (6, "http://c.org/1?ref=x", shell.format(one))]  # copies, and below versions: most of the text is shared
    rows += [(7, "http://d.org/1", shell.format(one + two + "<article>Posted first</article>")), (8, "http://d.org/1/all", shell.format(one + two))]
    rows += [(9, "http://e.org/1", shell.format(one))]
    ends = ("News > Local ", " Fair opens Read on Back to top")
    whole = {5: story, 6: story, 7: f"{story} {other} Posted first", 8: f"{story} {other}", 9: story}
    want = {1: story, 2: other, 3: "leek soup for many Ingredients Take leek, and water and salt.", 4: "pea soup for many Ingredients Take pea, and water and salt."} | {i: ends[0] + t + ends[1] for i, t in whole.items()}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == want
    monkeypatch.setattr(html_text, "line_hashes", lambda lines: [])
    alone = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert alone == want | {1: ends[0] + story + ends[1], 2: ends[0] + other + ends[1], 3: "Recipes " + want[3], 4: "Recipes " + want[4]}


def test_copies_under_two_urls_keep_their_text(spark):
    page = "<body><div>Menu</div><div>The story</div></body>"
    rows = [(1, "http://a.org/1", page), (2, "http://a.org/1?utm_source=feed", page), (3, "http://b.org/1", page), (4, "http://b.org/2", page.replace("The", "Another"))]
    rows += [(5, "http://c.org/1", page + "<nav>Up</nav>"), (6, "http://c.org/2", page + "<nav>Down</nav><p>Printed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {1: "Menu The story", 2: "Menu The story", 3: "The story", 4: "Another story", 5: "Menu The story", 6: "Printed"}
