"""The tree's decisions by flat features, contract pages, and the defined results of the extraction."""

from skerry.llm import html_extract
from skerry.llm.html_extract import FEATURES, decide, main_text

TREE = html_extract.train()


def keeps(**features):
    return decide(TREE, [features.get(f, 0.0) for f in FEATURES])


def words(n, word="word"):
    return " ".join([word] * n)


def test_link_density_alone_decides():
    near = {"words": 60, "words_before": 50, "words_after": 50}
    assert keeps(**near) == 1 and keeps(**near, link_density=0.8) == 0
    assert keeps(**near, hint=1, link_density=0.8) == 0  # inside an article too


def test_words_alone_decide():
    near = {"words_before": 5, "link_density_before": 1.0, "words_after": 5, "link_density_after": 0.5}
    assert keeps(words=4, **near) == 0 and keeps(words=40, **near) == 1


def test_a_neighbour_alone_decides():
    near = {"words": 8, "words_before": 6, "link_density_before": 1.0}
    assert keeps(**near, words_after=70) == 1 and keeps(**near, words_after=4) == 0
    assert keeps(words=5, words_before=5, link_density_before=1.0, words_after=70) == 1 and keeps(words=5, words_before=5, link_density_before=1.0, words_after=3, link_density_after=1.0) == 0


def test_articles_keep_every_link_poor_block():
    for n in (1, 2, 3, 6, 10, 30, 200):
        for before in ((0, 0), (1, 1), (2, 0), (5, 1), (40, 0), (90, 0)):
            for after in ((0, 0), (1, 0), (3, 1), (20, 0), (80, 0)):
                assert keeps(words=n, hint=1.0, words_before=before[0], link_density_before=before[1], words_after=after[0], link_density_after=after[1]) == 1


def test_the_tree_begins_with_link_density():
    assert FEATURES[TREE[0]] == "link_density"


def test_page_without_article_or_names():
    page = f"<body><div><a>Home</a></div><div><a>News</a></div><div>Buy now</div><div><a>All</a></div><div>A title of the page</div><div>{words(70)}</div><div>{words(55, 'more')}</div><div>A short end of the text stands here.</div><div><a>Impressum</a></div></body>"
    assert main_text(page, TREE) == f"A title of the page\n{words(70)}\n{words(55, 'more')}\nA short end of the text stands here."


def test_misleading_names_lose_no_text():
    """A hint on the wrapper of an article, on a title's wrapper, and as part of a paragraph's class."""
    body = f"<p>{words(60)}</p><p class='text-share-price'>Shares fell.</p><p>{words(40, 'more')}</p>"
    page = f"<body><div class='banner'><article><div class='post-header'><h1>The title</h1></div>{body}<p>Short end.</p></article></div><footer><a>Contact</a></footer></body>"
    assert main_text(page, TREE) == f"The title\n{words(60)}\nShares fell.\n{words(40, 'more')}\nShort end."
    wrapped = f"<body><div id='main-banner'><div>{words(90)}</div><div>{words(80, 'b')}</div><div>{words(70, 'c')}</div></div></body>"
    assert main_text(wrapped, TREE) == f"{words(90)}\n{words(80, 'b')}\n{words(70, 'c')}"


def test_what_is_no_article_goes():
    """Menus, header, footer, sidebar, notice, adverts (a paragraph's class too), forms, scripts, styles, comments."""
    page = f"""<html><head><title>no</title><style>p {{}}</style></head><body><header><h2>Site name</h2></header><nav><ul><li><a>A</a><li><a>B</a></ul></nav>
    <div class="cookie-notice">We use cookies to serve you better, please agree to all of them today.</div><article><h1>Title &amp; more</h1><p>{words(50)}<p class="advert">Buy this now</p>
    <script>var a = "<p>no</p>";</script><p>One<br>two&nbsp;three</p><aside>Read also</aside><form><p>{words(30, 'form')}</p></form></article>
    <div id="comments"><p>{words(60, 'opinion')}</p><p>{words(70, 'reply')}</p></div><aside><p>{words(40, 'side')}</p></aside><footer>All rights reserved. {words(30, 'foot')}</footer></body></html>"""
    assert main_text(page, TREE) == f"Title & more\n{words(50)}\nOne two three"


def test_long_comments_notices_and_adverts_go_whatever_their_place():
    body = f"<h1>The title</h1><p>{words(60)}</p>"
    for name in ("user-comments", "comment-list", "reader-comments", "article__comments x-comments"):
        assert main_text(f"<body><article>{body}</article><div class='{name.split()[-1]}'><p>{words(90, 'opinion')}</p></div></body>", TREE) == f"The title\n{words(60)}"
    for box in ("<div class='notice'>", "<div id='cookie-bar'>", "<div class='advert large'>", "<section class='ad-slot'>"):
        page = f"<body><article>{body}{box}{words(60, 'notice')}</{box[1:].split()[0]}><p>More of the text.</p></article></body>"
        assert main_text(page, TREE) == f"The title\n{words(60)}\nMore of the text."
    assert main_text(f"<body><main>{body}<p class='banner'>{words(60, 'sale')}</p></main></body>", TREE) == f"The title\n{words(60)}"
    assert main_text(f"<body><article class='has-comments'>{body}</article></body>", TREE) == f"The title\n{words(60)}"


def test_a_paragraph_that_is_one_link_stays():
    page = f"<body><nav><a>Home</a></nav><article><h1>The title</h1><p>{words(60)}</p><p><a href='x'>the whole report of the year is here</a></p><p>{words(30)}</p><p><a>Read more</a></p><ul><li><a>One other story of today</a></li></ul></article></body>"
    assert main_text(page, TREE) == f"The title\n{words(60)}\nthe whole report of the year is here\n{words(30)}"


def test_pages_in_spark(spark):
    """Repeated rows, a clashing name, a long page; and the whole table against the plain function."""
    rows = [(1, "u", f"<main><p>{words(9000, 'long')}</p></main>", "x")] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [r.text for r in html_extract.extract(df).collect()] == [words(9000, "long")] * 3
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {(r.page_id, r.url): r.text for r in html_extract.extract(pages).collect()}
    assert got == {(r.page_id, r.url): main_text(r.html, TREE) for r in pages.collect()}


def test_defined_results(spark):
    long_ = words(300_000, "ümlaut")
    rows = [(1, "u", f"<article><p>{long_}</p></article>", 1), (None, None, None, 2), (2, "u", "", 3), (2, "u", "", 3), (3, "u", "<nav><a>x</a></nav>", 4), (4, None, "plain &lt; text " + words(30), 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text) for r in html_extract.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", long_), (None, None, ""), (2, "u", ""), (2, "u", ""), (3, "u", ""), (4, None, "plain < text " + words(30))], key=repr)
    assert html_extract.extract(df.limit(0)).count() == 0
