import itertools
import random

import numpy as np
import pytest

from folioforge.llm import extraction
from folioforge.llm.extraction import Graph, extract_text, fit_text, main_blocks, minimum_cut, train_text
from folioforge.llm.html_blocks import read_page
from folioforge.llm.queries import ORACLES, QUERIES


def blocks(source):
    return [b.text for b in read_page(source).blocks]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<p>a<p>b<br>c</p> d <b>e\n f</b>", ["a", "b c", "d e f"]),
        ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>five", ["one", "two", "three", "four", "five"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("x<script>var t='<p>no</p>';</script>y<style>p{}</style>z<!-- <p>no</p> -->!", ["xyz!"]),
        ("<p title='>'>a</p><p data-x=\"<b>\">b</p><p class=it's>don't</p>", ["a", "b", "don't"]),
        ("&amp;lt;b&amp;gt; &#65;&#x42; &eacute;&nbsp;&nbsp;x &copy 1 < 2 &unknown; a<3", ["&lt;b&gt; AB é x © 1 < 2 &unknown; a<3"]),
        ("<div hidden>no<div>no</div>no</div><span style='display: none'>no<span>no</span>no</span>yes<svg><text>no</text></svg>", ["yes"]),
        ("<head><title>no</title></head><body>a<select><option>no</select><button>no</button><noscript>no</noscript><textarea>no</textarea>b", ["ab"]),
        ("</div></p>a</body></html>b", ["a", "b"]),
        ("<P>Big</P><!DOCTYPE x><?php no ?><P>Two", ["Big", "Two"]),
        ("<p>a<!-- open comment <p>b", ["a"]),
        ("<p>a</p><p", ["a"]),
        ("", []), ("   \n", []), ("<<<>>>", ["<<<>>>"]), ("plain", ["plain"]),
    ],
)
def test_blocks(source, expected):
    assert blocks(source) == expected


def test_links_are_measured():
    (a, b) = read_page("<li><a href=x>all of it</a></li><p>some <a>of</a> it").blocks
    assert (a.linked, b.linked) == (9, 2)


def capacity(graph, side):
    cost = sum(t if t > 0 and not s else -t if t < 0 and s else 0 for t, s in zip(graph.terminal, side, strict=True))
    return cost + sum(c for v, own in enumerate(graph.edges) for u, c in own.items() if u > v and side[u] != side[v])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_the_least(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 10)
    graph = Graph([rng.choice([0, rng.randrange(-9, 10)]) for _ in range(n)], [{} for _ in range(n)])
    for a, b in itertools.combinations(range(n), 2):
        if rng.random() < 0.5:
            graph.join(a, b, rng.randrange(1, 8))
    least = min(capacity(graph, side) for side in itertools.product([False, True], repeat=n))
    assert capacity(graph, minimum_cut(graph)) == least


def test_long_page_is_cut_in_time():
    rng = random.Random(4)
    n = 30_000
    graph = Graph([rng.randrange(-2000, 2001) for _ in range(n)] + [0], [{} for _ in range(n + 1)])
    for k in range(n):
        graph.join(k, n, 400)
        if k:
            graph.join(k - 1, k, 1200)
    assert len(minimum_cut(graph)) == n + 1


STORY = ["The harbour was quiet on the morning after the storm, and boats lay where the water had left them.", "Short line.", "By noon, people had begun to carry planks, ropes and nails to the shore; nobody spoke of leaving.", "A list of what was lost:", "three nets", "one sail", "The council met at six, and agreed to rebuild the pier before winter."]
ARTICLE = f"<h1>After the storm</h1><p>{STORY[0]}</p><p>{STORY[1]}</p><p>{STORY[2]}</p><h2>{STORY[3]}</h2><ul><li>{STORY[4]}</li><li>{STORY[5]}</li></ul><p>{STORY[6]}</p>"
WANTED = ["After the storm", *STORY]
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/n>News and more</a></li><li><a href=/c>Contact</a></li></ul>"
LONG = "I do not agree with the council at all, since the pier was old, the storm was not the last, and money is short in every house."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>{NAV}</nav><div class=ad>Buy planks now. Cheap planks, today only.</div><article>{ARTICLE}</article><footer>&copy; Harbour Post</footer></body>",
        f"<header><h1>Harbour Post</h1>{NAV}</header><main>{ARTICLE}</main><aside><h3>Most read</h3><p>{LONG}</p></aside><footer><p>{LONG}</p></footer>",
        f"<div id=header>{NAV}</div><div id=content>{ARTICLE}</div><div id=sidebar><p>{LONG}</p></div><div id=footer>All rights reserved.</div>",
        f"<div class='cookie-banner'><p>We use cookies, and so do our partners. {LONG}</p></div><div class='wrapper has-sidebar'><div class='post-body'>{ARTICLE}</div><div class='comments'><h2>2 comments</h2><p>{LONG}</p><p>{LONG}</p></div></div>",
        f"<article><header><h1>After the storm</h1></header>{ARTICLE.replace('<h1>After the storm</h1>', '')}<section id=comments><article class=comment><p>{LONG}</p></article></section></article>",
        f"<form id=aspnetForm><div class=menu>{NAV}</div><div class=main>{ARTICLE}</div></form><form class=login><p>Name <input> and {LONG}</p></form>",
        f"<main><nav class=breadcrumb><a>Home</a> / <a>News</a></nav><article>{ARTICLE}</article><div class='newsletter-signup'><form><p>{LONG}</p></form></div><section class='related-posts'><article><h3>More</h3><p>{LONG}</p></article></section></main>",
        f"<body>{NAV}<div>{ARTICLE}</div><div><p>&copy; 2024 Harbour Post. All rights reserved.</p></div></body>",
        f"<div role=navigation>{NAV}</div><div role=main>{ARTICLE}</div><div role=complementary><p>{LONG}</p></div><div role=contentinfo><p>{LONG}</p></div><div role=alert>{LONG}</div>",
        f"<table><tr><td class=nav>{NAV}</td><td>{ARTICLE}</td></tr></table><script>var x = '<p>no</p>'</script>",
    ],
)
def test_known_pages(page):
    assert main_blocks(page) == WANTED


def test_training_moves_weights_and_stays_near_the_prior():
    rng = np.random.default_rng(3)
    x = np.zeros((400, len(extraction.FEATURES)))
    x[:, 0] = 1
    x[:, 7] = y = rng.integers(0, 2, 400)  # items are main text here
    w = fit_text(x, y)
    assert w[7] > extraction.PRIOR[7] + 1 and w[3] == extraction.PRIOR[3]
    assert (fit_text(x[:0], y[:0]) == extraction.PRIOR).all()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], "page_id long, url string, html string, text string, place string, n_chars int").repartition(2)


def test_odd_rows(spark):
    long = "<article>" + "<p>word and word, again.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<script>x"), (4, "u", long), (5, "u", "<p>" + "é" * 100_000), (6, "u", f"<article>{ARTICLE}</article>"), (6, "u", f"<article>{ARTICLE}</article>")]
    found = extract_text(frame(spark, rows))
    assert found.columns == ["page_id", "url", "place", "text", "n_chars"]
    got = sorted(((r.page_id, r.n_chars, r.text) for r in found.collect()), key=str)
    assert all(n == len(t) for _, n, t in got) and len(got) == len(rows)
    assert [n for i, n, _ in got if i in (1, 2, 3, None)] == [0] * 4
    assert [t for i, _, t in got if i == 4] == ["\n".join(["word and word, again."] * 20_000)]
    assert [t for i, _, t in got if i == 6] == ["\n".join(WANTED)] * 2


def test_empty_table(spark):
    none = frame(spark, [])
    assert (train_text(none) == extraction.PRIOR).all() and extract_text(none).collect() == []


def test_training_is_the_same_for_any_partitioning(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert (train_text(pages) == train_text(pages.repartition(7))).all()


def test_query_equals_its_sql(same):
    same(QUERIES["op13_html_extraction"], ORACLES["op13_html_extraction"])
