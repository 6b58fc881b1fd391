import random
from html.parser import HTMLParser

import numpy as np

from scriptorium.llm.html_blocks import BlockConfig, block_sums, extract, main_text, surges
from scriptorium.llm.queries import op1_html_blocks
from tests.llm.helpers import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:">"}</style><script>var t="</p>";</script></head>
<body class="no-sidebar"><header>Site name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s<div id='comments'><div>Great post</div><p>me too</p></div><form><label>Mail</label><input></form><aside>Side</aside><footer>&copy; site</footer></body></html>"""


def test_article_alone_stays():
    body = "<article><header><h1>A &amp; B</h1></header><p><b>First\n  block<br>more&nbsp;text<div class=\"ad\">Buy <div>now</div></div><p>x</p><p>Short.</article>"
    assert main_text(PAGE % body) == "A & B First block more text x Short."
    assert main_text(PAGE % body.replace("article", "main")) == "A & B First block more text x Short."


def test_article_by_distribution_alone():
    body = "<div><h1>Title</h1>" + "".join(f"<p>Paragraph {i} with a good many words in it.</p>" for i in range(4)) + "</div>"
    assert main_text(PAGE % body) == "Title " + " ".join(f"Paragraph {i} with a good many words in it." for i in range(4))
    menu = "<div>" + "".join(f"<a href='/{i}'>Link number {i}</a><br>" for i in range(9)) + "</div><hr><hr><hr>"
    assert main_text(f"<body>{menu}{body}</body>").startswith("Title Paragraph 0")


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<br><p></p>") == main_text("<!-- only -->") == ""
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<p>1 < 2 and <3</p>") == "1 < 2 and <3"
    assert main_text("<script>never closed <p>x</p>") == ""
    assert main_text("<article>" + "<p>word</p>" * 20_000 + "</article>") == " ".join(["word"] * 20_000)
    assert main_text("<article><p>a</p><" + "x" * 50_000) .startswith("a")


def test_surges_equal_a_slow_search():
    rng = random.Random(3)
    for _ in range(50):
        weights = [rng.choice((0, 0, 3, 40)) for _ in range(rng.randrange(1, 30))]
        for window in (1, 3, 5):
            sums = [sum(weights[max(0, i - window + 1) : i + 1]) for i in range(len(weights))]
            assert block_sums(np.array(weights), window).tolist() == sums
            above = [i for i, x in enumerate(sums) if x > 5]
            ends = [(i, next(j for j in range(i, len(sums) + 1) if j not in above)) for i in above if i - 1 not in above]
            assert surges(np.array(sums), 5) == ends


def test_operator_and_query(spark, sf):
    schema = "page_id long, url string, html string, text int, n_chars int"
    rows = [(1, "u", None, 0, 0), (1, "u", None, 0, 0), (2, None, "<p>hi", 0, 0), (None, "v", "", 0, 0)]
    assert sorted(map(tuple, extract(spark.createDataFrame(rows, schema)).collect()), key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "hi", 2), (None, "v", "", 0)], key=str)
    assert extract(spark.createDataFrame([], schema)).collect() == []
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    got = op1_html_blocks(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        html = pages[r.page_id].html
        article = html[html.index("<article>") : html.index("</article>")]
        assert r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text
        assert r.text == main_text(article + "</article>")


def test_dropped_elements_do_not_end_the_article():
    paragraphs = [f"<p>{i} {'word ' * 59}</p>" for i in range(7)]
    text = " ".join(f"{i} {'word ' * 59}".strip() for i in range(7))
    for inside in ("<script>x()</script>", "<iframe src='v'></iframe>", "<div class='ad'>Buy</div>", "<aside>Side</aside>", "<button>Play</button>", "<form><input></form>"):
        assert main_text("<body><div>" + "".join(paragraphs[:5]) + inside + "".join(paragraphs[5:]) + "</div></body>") == text
    assert main_text("<body><div>" + "<div class='ad'>Buy</div>".join(paragraphs) + "</div></body>") == text
    short = f"<article>{paragraphs[0]}</article>"
    assert main_text("<body><article>" + "".join(paragraphs[1:]) + "</article>" + short + "</body>").endswith("0 " + ("word " * 59).strip())


class Article(HTMLParser):
    """The text between the article tags, by the standard parser alone."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.parts = False, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.parts += [" "] * (tag in ("p", "br", "h1"))

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.parts += [" "] * (tag in ("p", "h1"))

    def handle_data(self, data):
        self.parts += [data] * self.inside


def test_query_equals_another_parser_with_and_without_the_tag(spark, sf):
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    for r in op1_html_blocks(spark, sf).collect():
        html = pages[r.page_id].html
        want = " ".join("".join(Article(html).parts).split())
        assert r.text == want and main_text(html.replace("<article>", "<div>").replace("</article>", "</div>")) == want


def test_surge_and_dive_points_hold_inside_the_article():
    links = "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(9))
    text = "<p>A first paragraph with words.</p><p>A second one with words.</p>"
    got = main_text(f"<article><h1><a href='/'>Title</a></h1>{text}<ul>{links}</ul><p>By an author.</p></article>")
    assert got.startswith("Title A first") and got.endswith("By an author.") and "Link number 5" not in got


def test_hinted_wrappers_keep_their_article():
    text = " ".join(f"Paragraph {i} with a good many words in it." for i in range(4))
    body = "".join(f"<p>Paragraph {i} with a good many words in it.</p>" for i in range(4))
    for wrapper in ("<div class='no-sidebar'>%s</div>", "<div id='content-with-sidebar'>%s</div>", "<section class='search-result-page'>%s</section>"):
        assert main_text(PAGE % (wrapper % body)) == main_text(PAGE % (wrapper % f"<article>{body}</article>")) == text
    assert main_text(PAGE % f"<div class='share sidebar'><article>{body}</article></div>") == text
    assert main_text(PAGE % f"<form id='search'><div class='widget'><main>{body}</main></div></form>") == text
    comments = "<div class='comments'><article>A comment with a good many words in it, too.</article></div>"
    assert main_text(PAGE % f"<article>{body}</article>{comments}") == text
    assert main_text(PAGE % f"<article>{body}</article><div class='sidebar left'>Some words at the side of it.</div>") == text


PARAGRAPHS = "<h1>T of it</h1><p>" + "word and more " * 20 + "</p><p>" + "second one too " * 20 + "</p>"
PARAGRAPHS_TEXT = ("T of it " + "word and more " * 20 + "second one too " * 20).strip()


def test_no_unclosed_tag_and_no_name_loses_an_article():
    menu = "<ul><li><a href='/x'>Menu</a></li></ul>"
    for body in (f"<article>{PARAGRAPHS}</article>", f"<div>{PARAGRAPHS}</div>"):
        for page in (f"<nav>{menu}{body}", f"<div class='ad'>Buy now{body}", f"<div class='layout with-sidebar'>{body}</div>", f"<div id='search-results-page'>{body}</div>", f"<div class='widget'>{body}</div>", f"<a href='/'>Home{body}", f"<select>{body}", f"<iframe>{body}"):
            assert main_text(f"<body>{page}") == PARAGRAPHS_TEXT, page
    inside = PARAGRAPHS.replace("</p><p>", "</p><div class='ad'>Buy now<p>")
    assert main_text(f"<body><div>{inside}<p>{'third one too ' * 20}</p>") == (PARAGRAPHS_TEXT + " " + "third one too " * 20).strip()


def test_short_runs_and_further_articles_stay():
    short = "<p>twelve words in here are a few and then some more ok</p>"
    for notice in ("<div class='notice'>Note well</div>", "<form>Note well</form>", "<aside>Note well</aside>"):
        for body in (f"<div>{PARAGRAPHS}{notice}{short}</div>", f"<article>{PARAGRAPHS}{notice}{short}</article>"):
            assert main_text(f"<body>{body}</body>") == PARAGRAPHS_TEXT + " " + short[3:-4]
    assert main_text(f"<article>{PARAGRAPHS}</article><article>{short}</article>") == PARAGRAPHS_TEXT + " " + short[3:-4]
    for body in (f"<article>{PARAGRAPHS}</article>", f"<div>{PARAGRAPHS}</div>"):
        assert main_text(f"<body><div>A tagline of ours</div>{body}<div>Copyright 2024 by us</div></body>") == PARAGRAPHS_TEXT
        comments = "<div id='comments'>" + "<div class='comment'><p>" + "I say so too and more " * 30 + "</p></div>" * 3 + "</div>"
        assert main_text(f"<body>{body}{comments}</body>") == PARAGRAPHS_TEXT


def test_the_distribution_alone_finds_the_article(spark, sf):
    pages = [r.html for r in table(spark, sf, "pages").collect()]
    want = [" ".join("".join(Article(html).parts).split()) for html in pages]

    def share(config):
        return sum(main_text(html, config) == text for html, text in zip(pages, want, strict=True)) / len(pages)

    assert share(BlockConfig(names=False, bounds=False)) >= 0.9 and share(BlockConfig(bounds=False)) == 1


def test_named_elements_inside_the_article_keep_their_prose():
    long = "<p>" + "a further paragraph of the article " * 8 + "</p>"
    text = ("a further paragraph of the article " * 8).strip()
    for element in ("<section class='social-science'>%s</section>", "<div class='banner-text'>%s</div>", "<div class='related-work'><h2>Related work</h2>%s</div>"):
        title = "Related work " if "h2" in element else ""
        for body in ("<article>%s</article>", "<main>%s</main>", "<div>%s</div>"):
            assert main_text(PAGE % (body % (PARAGRAPHS + element % long))) == f"{PARAGRAPHS_TEXT} {title}{text}", (element, body)
    links = "".join(f"<li><a href='/{i}'>Another page of this site, number {i}</a></li>" for i in range(9))
    for box in (f"<div class='related'><h3>Related</h3><ul>{links}</ul></div>", "<div class='promo'>Buy now</div>", f"<div class='comments'>{long}</div>", f"<div id='user-responses'>{long}</div>"):
        for body in ("<article>%s</article>", "<main>%s</main>"):
            assert main_text(PAGE % (body % (PARAGRAPHS + box))) == PARAGRAPHS_TEXT, box
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>") == "Let x=1 be."
