from __future__ import annotations

import random
import re
from html import unescape

import pytest

from salesmart.llm import html
from salesmart.llm.queries import op2_html


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, template string")


def page(title: str, paragraphs: list[str], more: str = "") -> str:
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:"</article>"}}</style><script>var t="<p>";</script></head><body>'
        '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
        f'<div class="ad">Buy &amp; save</div><!-- <article>no</article> --><article><h1>{title}</h1>{body}{more}</article>'
        '<aside>More</aside><section id="comments"><p>First!</p></section><form><p>Sign up</p></form><footer>&copy; site</footer></body></html>'
    )


def texts(spark, rows) -> dict:
    return {r.page_id: r.text for r in html.extract(table(spark, rows)).collect()}


def test_articles_without_their_surroundings(spark):
    rows = [(i, f"https://one.example/{i}", page(f"Title {i}", [f"word{i} <b>bold</b>  a&lt;b\n &amp;c", f"second<br>line {i}"], '<div class="share">Tell</div>'), "old", "t") for i in range(12)]
    found = texts(spark, rows)
    assert found == {i: f"Title {i}\nword{i} bold a<b &c\nsecond line {i}" for i in range(12)}


def test_query_gives_whole_articles(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in op2_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = p.html.split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        expected = "\n".join(b for b in blocks if b)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (expected, len(expected), p.url)


def test_template_of_a_host(spark):
    rows = [(i, "host", page(f"T{i}", [f"p{i}"] * (1 + i % 3))) for i in range(6)]
    (told,) = html.templates(spark.createDataFrame(rows, "page_id bigint, host string, html string")).collect()
    main, constant = html.read_template(told.template, 30)
    assert told.host_pages == 6 and main == "article"
    marks = [m for c in html.json.loads(told.template) for m in c["marks"]]
    assert "</html/body/article" in marks and not any(m.endswith("article/p") for m in marks if m[0] == "<" and marks.count(m) > 1)
    (root,) = [c for c in html.json.loads(told.template) if "</html" in c["marks"]]
    inside = ["</html", "</html/body", "</html/body/article", "</html/body/article/h1", ">/html/body/article/h1", ">/html/body/article", ">/html/body", ">/html"]
    assert [m for m in root["marks"] if m in inside] == inside  # nested in the order of the page


def test_pages_without_an_article(spark):
    shared = "<nav>Menu</nav><div>Every page says this</div>"
    rows = [(i, "http://two.example/", f"<html><body>{shared}<div>Only page {i}</div><p>and more {i}</body></html>", None, None) for i in range(html.CONSTANT_PAGES)]
    assert texts(spark, rows) == {i: f"Only page {i}\nand more {i}" for i in range(html.CONSTANT_PAGES)}
    few = texts(spark, rows[:2])
    assert few[0] == "Every page says this\nOnly page 0\nand more 0"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<article><p>a<p>b<ul><li>c<li>d</ul>e</article>", "a\nb\nc\nd\ne"),
        ("<article>cut off in the mid", "cut off in the mid"),
        ("<article>x<p>y</p", "x\ny"),
        ("<article>a &am &amp; &#233;&nbsp;z</article>", "a &am & é z"),
        ("<ARTICLE CLASS='post'><P>up</P></ARTICLE>", "up"),
        ("<main><p>in main</p><footer>no</footer></main><p>out</p>", "in main"),
        ("<article><header><h1>Own</h1></header>t</article><article>u</article>", "Own\nt\nu"),
        ('<article>a <a title="x > y" href=z>link</a>, b</article>', "a link, b"),
        ("<article><script>if (a<b) {}</script><style>p</style><textarea><p></textarea>t</article>", "t"),
        ("< no tag <article>1 < 2</article>", "1 < 2"),
        ("", ""),
    ],
)
def test_markup(source, expected):
    assert html.main_text(source, "", frozenset()) == expected


def test_edge_rows(spark):
    long = "<article>" + "<p>text &amp; more</p>" * 20_000 + "</article>"
    rows = [(1, "http://a/", None, None, None), (2, None, "", "x", "x"), (3, None, "<article>n</article>", None, None), (4, "not a url", long, None, None)]
    rows += [(5, "http://a/", "<article>same</article>", None, None)] * 2 + [(None, "http://a/", "<article>i</article>", None, None)]
    docs = table(spark, rows)
    found = html.extract(docs).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r.text for r in found}
    assert (by[1], by[2], by[3], by[5], by[None]) == ("", "", "n", "same", "i")
    assert by[4] == "\n".join(["text & more"] * 20_000)
    assert html.extract(docs.where("false")).count() == 0


@pytest.mark.parametrize("around", ['div class="layout has-sidebar"', 'div class="no-sidebar nav-open"', "form id=aspnetForm", 'section id="notice-page"', "header", 'div role="form"'])
def test_marks_around_the_article_do_not_drop_it(around):
    close = around.split()[0]
    source = f'<body><{around}><nav>Menu</nav><article><p>text</p><div class="share">no</div></article><aside><article>teaser</article></aside></{close}><footer>f</footer></body>'
    assert html.main_text(source, "article", frozenset()) == "text"
    assert html.main_text("<aside><article>a</article></aside><form><article>b</article></form>", "", frozenset()) == "a\nb"


def host(spark, sources: list[str]):
    (told,) = html.templates(spark.createDataFrame([(i, "h", s) for i, s in enumerate(sources)], "page_id bigint, host string, html string")).collect()
    return told


def numbered(source: str) -> list[int]:
    return [n for token in html.tokens(source) if (n := html._number(*token)) is not None]


def test_classes_are_checked_for_order(spark):
    a, b = '<div class="a">A</div>', '<div class="b">B</div>'
    told = host(spark, [f"<html><body>{a + b if i % 2 else b + a}<p>{i}</p></body></html>" for i in range(6)])
    kept = [{m for m in c["marks"] if m[-2:] in (".a", ".b")} for c in html.json.loads(told.template) if c["nested"]]
    both = {"</html/body/div.a", ">/html/body/div.a"}, {"</html/body/div.b", ">/html/body/div.b"}
    assert all(some in kept for some in both) and all(some in (set(), *both) for some in kept)


def test_of_classes_that_straddle_the_one_on_more_pages_is_kept(spark):
    a, b, c, d = (f'<div class="{x}"></div>' for x in "abcd")
    told = host(spark, [f"<body>{a}{b}{c}{d}</body>"] * 3 + [f"<body>{a}{c}</body>"])
    classes = {c["marks"][0]: c["nested"] for c in html.json.loads(told.template)}
    assert classes["</body"] and not classes["</body/div.b"]


def test_roles_are_told_apart_by_the_classes_around_them(spark):
    rows = [(i, "http://r/", f"<body><div>Home</div><hr><div>{'Home' if i % 3 else 'Away'}</div><div>Story {i}</div></body>", None, None) for i in range(12)]
    assert texts(spark, rows) == {i: f"{'Home' if i % 3 else 'Away'}\nStory {i}" for i in range(12)}


def test_slots_of_the_article_are_told_from_lists_of_articles(spark):
    def source(i: int) -> str:
        more = "".join(f"<article><p>Reply {i} {j}</p></article>" for j in range(i % 4))
        return f'<body><div class="story"><article><h1>Title of {i}</h1><p>page {i} says more than its replies {i}</p></article></div><div class="responses">{more}</div></body>'

    rows = [(i, "http://s/", source(i), None, None) for i in range(6)]
    rows.append((6, "http://s/", "<body><div class='responses'><article>alone</article></div></body>", None, None))
    rows += [(7, "http://s/", "", None, None), (8, "http://s/", None, None, None)]
    found = texts(spark, rows)
    assert found == {i: f"Title of {i}\npage {i} says more than its replies {i}" for i in range(6)} | {6: "alone", 7: "", 8: ""}


def test_an_article_that_all_pages_have_does_not_drop_their_stories(spark):
    def source(i: int) -> str:
        posts = "".join(f"<article><p>Post {i} {j}</p></article>" for j in range(1 + i % 3))
        return f'<body><div class="posts">{posts}</div><div class="about"><article>About us</article></div><div id="p{i}"><article>own {i}</article></div></body>'

    found = texts(spark, [(i, "http://s/", source(i), None, None) for i in range(12)])
    assert found == {i: "\n".join([*(f"Post {i} {j}" for j in range(1 + i % 3)), "About us", f"own {i}"]) for i in range(12)}


@pytest.mark.parametrize("seed", range(3))
def test_templates_are_ordered_and_nested_on_all_pages(spark, seed):
    """By brute force over all pairs of spans; no role of the template stands in two of its slots."""
    rng = random.Random(seed)

    def some(depth: int) -> str:
        inner = [f'<div class="{rng.choice("abcd")}">{some(depth - 1)}</div>' if depth and rng.random() < 0.6 else f"<p>{rng.choice('uvw')}</p>" for _ in range(rng.randint(1, 3))]
        return "".join(inner)

    fixed = ['<div class="x"><p>u</p></div>', '<div class="y">', "</div>", '<ul><li>u<li>v</ul>']
    pages = [f"<html><body>{fixed[0]}{some(2)}{fixed[1]}{some(1)}<p>u</p>{fixed[2]}{fixed[3]}{some(1)}</body></html>" for _ in range(8)]
    told = host(spark, pages)
    classes = [c["roles"] for c in html.json.loads(told.template) if c["nested"]]
    assert any("</html/body/div.y" in c["marks"] for c in html.json.loads(told.template) if c["nested"])
    slots: dict[int, set] = {}
    for source in pages:
        roles = html.roles_of(numbered(source), told.rounds)
        at = {r: [i for i, x in enumerate(roles) if x == r] for c in classes for r in c}
        spans = []  # places of each time that a class's tokens take their turn
        for c in classes:
            turns = list(zip(*(at[r] for r in c), strict=True))
            flat = [i for turn in turns for i in turn]
            assert flat == sorted(flat)
            spans += [(c[0], turn) for turn in turns]
        for first, turn in spans:
            for other, inner in spans:
                within = [{sum(i > j for j in one) for i in two} for one, two in ((turn, inner), (inner, turn))]
                assert first == other or min(map(len, within)) == 1  # all in one gap of the other, or beside it
            around = [(turn2[0] - turn2[-1], c2, sum(turn[0] > j for j in turn2)) for c2, turn2 in spans if turn2[0] < turn[0] and turn[-1] < turn2[-1]]
            slots.setdefault(first, set()).add(max(around)[1:] if around else None)
    assert all(len(s) == 1 for s in slots.values())


def test_cuts_make_classes_take_turns():
    template = [{"roles": [1, 2, 3, 4], "marks": ["<a", "<b", ">b", ">a"], "mains": [""] * 4, "pages": 2, "times": 2, "nested": True}]
    read = html.read_round(html.json.dumps(template))
    assert not list(html._disorders([1, 2, None, 3, 4, 9, 1, 2, 3, 4], read))
    cuts = [{"a": a, "b": b} for a, b in html._disorders([2, 1, 4, 3], read)]
    assert [c["roles"] for c in html.ordered(template, cuts)] == [[1], [2, 3], [4]]
    assert [c["roles"] for c in html.ordered(template, cuts, together=True)] == [[1, 4], [2, 3]]
    assert html._turns([0, 1, 0, 2, 1, 2], 3) and html._turns([0, 1, 2, 2], 3)
