import html
import random
import re

import pytest

from kinfrag.llm import html_text
from kinfrag.llm.catalog import op3_html_text

ARTICLE = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head&amp;s</h1><p>One\n  two &eacute;&#33;&nbsp;x<br>y<p><b>Bold</b> text<aside>Side</aside><div id="comments">Nice</div></article><footer>&copy; f</footer></body></html>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (ARTICLE, "Head&s\nOne two é! x y\nBold text"),
        ("", ""),
        ("plain text", "plain text"),
        ("a &lt;b&gt; <i>c</i>d", "a <b> cd"),
        ("<p>a<p>b<ul><li>c<li>d</ul>", "a\nb\nc\nd"),
        ("<main><p>x</p></main><p>outside</p>", "x"),
        ("<article>a<nav>b</nav>c</article>", "a\nc"),
        ("<article><header><h1>t</h1></header>b</article><header>site</header>", "t\nb"),
        ("<div class='sidebar left'><div>x</div>y</div>z", "z"),
        ("<div class='headline'>x</div>", "x"),
        ("<article class='post related-story'><p>x</p></article>", "x"),
        ("<main id=sidebar><p class='widget-text'>x</p><div class=widget>y</div></main>", "x"),
        ("<article><p>teaser</p></article><div id='content'><p>x</p></div><p>z</p>", "teaser\nx"),
        ("<section role=main class='ad'>x</section>y", "x"),
        ("<p title='a>b'>x</p><p title=\"un>closed>y", 'x\nclosed>y'),
        ("<!-- <p>no</p> -->x<!-- open", "x"),
        ("x<script>open", "x"),
        ("<form><p>name</p></form><textarea>t</textarea>x", "x"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<div role=navigation>m</div><div hidden>h</div><span>s</span>", "s"),
        ("</div></p>x</article>", "x"),
        ("<article><div>a</article>b", "a"),
        ("&am &a &quo &amp x", "&am &a &quo & x"),
    ],
)
def test_pages(page, text):
    assert html_text.extracted(page, None) == text


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    return {r.page_id: r for r in html_text.main_text(df).collect()}


def words(a, n):
    return " ".join(f"{a}{i}" for i in range(n))


@pytest.mark.parametrize("bound", [500_000, 0])
def test_host_repetition_decides_where_no_landmark_does(spark, monkeypatch, bound):
    monkeypatch.setattr(html_text, "BROADCAST", bound)
    menu = "".join(f"<p>item {i} of menu</p>" for i in range(6))
    legal = f"<p>{words('legal', 40)}</p>"
    page = lambda i: f"<body>{menu}<p>{words(f'w{i}_', 60)}</p>{legal}</body>"
    rows = [(i, f"https://Host.net/{i}", page(i)) for i in range(5)] + [(10, "https://other.org/", page(10)), (11, "https://same.org/1", page(11)), (12, "https://same.org/2", page(11)), (13, None, page(13)), (14, "https://host.net/a", None), (15, "https://host.net/b", "")]
    out = run(spark, rows)
    assert len(out) == len(rows)
    for i in range(5):
        assert out[i].text == words(f"w{i}_", 60)
    for i in (10, 11, 12, 13):  # nothing repeats on another page of their host
        assert out[i].text.split("\n")[0] == "item 0 of menu" and out[i].text.endswith("legal39")
    assert (out[14].text, out[14].n_chars, out[15].text) == ("", 0, "")


def test_landmarks_keep_repeated_articles(spark):
    rows = [(i, "https://h.net/", f"<nav>{words('n', 30)}</nav><article><p>{words('a', 50)}</p><p>own {i}</p></article>") for i in range(3)]
    assert {r.text for r in run(spark, rows).values()} == {f"{words('a', 50)}\nown {i}" for i in range(3)}


def test_empty(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def cover(pages, length=html_text.LENGTH):
    """Kept text of pages of (host, html) without landmarks, by brute force over all strings."""
    streams = {}
    for host, page in pages:
        found = html_text.blocks(page)
        own = [(i, w) for i, b in enumerate(found) for w in b.text.split(" ")]
        pad = length - min(html_text.LEAST, len(own))
        streams[host, page] = (own, ["<"] * pad + [w for _, w in own] + [">"] * pad, pad)
    where = {}
    for (host, page), (own, marked, _) in streams.items():
        for p in range(len(marked) - length + 1) if own else ():
            where.setdefault((host, *marked[p : p + length]), set()).add(page)
    out = []
    for host, page in pages:
        own, marked, pad = streams[host, page]
        gone = {q - pad for p in range(len(marked) - length + 1) if own and len(where[(host, *marked[p : p + length])]) > 1 for q in range(p, p + length)}
        lines = {}
        for q, (i, w) in enumerate(own):
            if q not in gone:
                lines.setdefault(i, []).append(w)
        out.append("\n".join(" ".join(x) for x in lines.values()))
    return out


def test_pages_without_landmarks_equal_brute_force(spark):
    rng = random.Random(5)
    run_of = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
    shared = [run_of(n) for n in (3, 5, 15, 16, 17, 40)]
    pages = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else run_of(rng.randint(1, 40)))
        pages.append((f"h{i % 3}.net", "".join(f"<p>{' '.join(x)}</p>" for x in parts)))
    pages += [("h0.net", "<p>short</p>"), ("h0.net", "<div>short</div>"), ("h1.net", "<p>short</p>"), ("h2.net", pages[2][1])]
    out = run(spark, [(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)])
    assert [out[i].text for i in range(len(pages))] == cover(pages)
    assert out[40].text == out[41].text == "" and out[42].text == "short"


def test_all_streams_are_in_the_array(spark):
    menu, passage = f"<p>{words('menu', 20)}</p>", f"<p>{words('told', 30)}</p>"
    own = lambda i: f"<p>{words(f'own{i}_', 20)}</p>"
    rows = [
        (1, "http://a.net/1", f"<nav>{menu}</nav><article>{passage}{own(1)}</article>"),
        (2, "http://a.net/2", menu + own(2)),  # a menu by another page's landmark
        (3, "http://a.net/3", own(3) + passage + own(4)),  # passages of an article, on two pages without landmarks
        (4, "http://a.net/4", own(5) + passage + own(6)),
        (5, "http://b.net/5", menu + own(2)),  # of another host
    ]
    out = run(spark, rows)
    assert out[1].text == f"{words('told', 30)}\n{words('own1_', 20)}"
    assert out[2].text == words("own2_", 20)
    assert [out[i].text for i in (3, 4)] == ["\n".join((words(f"own{i}_", 20), words("told", 30), words(f"own{i + 1}_", 20))) for i in (3, 5)]
    assert out[5].text == f"{words('menu', 20)}\n{words('own2_', 20)}"


def parts_cover(pages, length=html_text.LENGTH):
    """Text of pages of (host, html) by brute force over all strings of all their parts."""
    where, split = {}, []
    for host, page in pages:
        found, parts = html_text.blocks(page), {}
        for said in (True, False, None):
            own = [(i, w) for i, b in enumerate(found) if b.content is said for w in b.text.split(" ")]
            pad = length - min(html_text.LEAST, len(own))
            marked = ["<"] * pad + [w for _, w in own] + [">"] * pad
            parts[said] = own, pad, [(host, *marked[p : p + length]) for p in range(len(marked) - length + 1)] if own else []
            for x in parts[said][2]:
                where.setdefault(x, set()).add((page, said))
        split.append((found, parts))
    out = []
    for found, parts in split:
        if parts[True][0]:
            out.append("\n".join(b.text for b in found if b.content))
            continue
        own, pad, strings = parts[None]
        gone = {q - pad for p, x in enumerate(strings) if len({page for page, _ in where[x]}) > 1 and all(said is not True for _, said in where[x]) for q in range(p, p + length)}
        lines = {}
        for q, (i, w) in enumerate(own):
            if q not in gone:
                lines.setdefault(i, []).append(w)
        out.append("\n".join(" ".join(x) for x in lines.values()))
    return out


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_pages_with_and_without_landmarks_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(html_text, "KNOWN", bound)
    rng = random.Random(8)
    run_of = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
    shared = [run_of(n) for n in (3, 4, 8, 15, 16, 17, 23, 40)]
    pages = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            tag = rng.choice(["p", "p", "p", "nav", "footer", "article"] if i % 2 else ["p", "p", "nav"])
            parts.append(f"<{tag}>{' '.join(rng.choice(shared) if rng.random() < 0.6 else run_of(rng.randint(1, 30)))}</{tag}>")
        pages.append((f"h{i % 2}.net", "".join(parts)))
    pages += [pages[5], pages[8], ("h1.net", pages[8][1])]
    out = run(spark, [(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)])
    assert [out[i].text for i in range(len(pages))] == parts_cover(pages)


def test_a_very_long_page(spark):
    page = "".join(f"<p>{words(f'p{i}_', 40)}</p>" for i in range(3000))
    out = run(spark, [(1, "http://a.net/", page), (2, "http://a.net/2", f"<p>{words('p7_', 40)}</p><p>own text of this page here</p>")])
    assert out[1].text.count("\n") == 2998 and "p7_" not in out[1].text and out[2].text == "own text of this page here"


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "<p>x y</p>", 5, 6, 7)], "page_id long, url string, html string, k1 int, covered int, pos int")
    assert [r.text for r in html_text.main_text(df).collect()] == ["x y"]


def test_query_on_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = op3_html_text(spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"<p>|</p>|</?h1>", inner.replace("<br>", " "))]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
