"""Block rules on hand-made pages, and the articles of the test pages."""

import html
import re
import time

from tillwork.llm.html_blocks import BAD, GOOD, OPEN, extract, main_text, second_pass

LONG = "This is the first part of a story that was told by the people of the town and it is not short at all, as you can see from it. "


def test_article_without_its_surroundings():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><header class=top>Site</header>
    <nav><a href=/a>One</a></nav><div class="cookie-notice">We use cookies &amp; more</div>
    <article><header><h1>Big &lt;Title&gt;</h1></header><p>Short.</p><p>A <a href=x>link</a> in   a\n line<br>goes on.<p>New &eacute;&#33;
    <script>if (a < b) {{ "</p>" }}</script></p><ul><li>point one<li>point two</ul><aside>Read also</aside>
    <div class="ad">Buy</div></article><section id="comments"><p>{LONG}</p></section><form><p>{LONG}</p></form>
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page).split("\n") == ["Big <Title>", "Short.", "A link in a line goes on.", "New é!", "point one", "point two"]


def test_rules_without_article():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>Title</h2><p>{LONG * 2}</p><p>Tiny.</p><p>{LONG * 2}</p><p>© 2020</p></body>"
    assert main_text(page).split("\n") == ["Title", (LONG * 2).strip(), "Tiny.", (LONG * 2).strip()]


def test_second_pass():
    assert second_pass([OPEN, OPEN], [False] * 2) == [GOOD, GOOD]
    assert second_pass([BAD, OPEN, GOOD], [False] * 3) == [BAD, BAD, GOOD]
    assert second_pass([BAD, OPEN, GOOD], [False, True, False]) == [BAD, GOOD, GOOD]
    assert second_pass([GOOD, OPEN, OPEN, OPEN, BAD], [False] * 5) == [GOOD, GOOD, BAD, BAD, BAD]


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<div class='x") == ""
    assert main_text("just text") == "just text"
    assert main_text("<p>kept <b>open &am") == "kept open &am"
    assert main_text("<p>a<!-- never closed <p>b") == "a"
    assert main_text("<script>x</p>") == ""
    assert main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert len(main_text("<article><p>" + "word " * 200_000)) == 999_999


def test_comments_and_scripts_own_what_they_hold():
    assert main_text('<p>a</p><script>var s="<!--";</script><p>b</p>') == "a\nb"
    assert main_text('<p>a</p><style>x{content:"<!--"}</style><p>b</p><!-- c --><p>d</p>') == "a\nb\nd"
    assert main_text('<p>a</p><script>x = "<![CDATA["; y = "<?"</script><p>b</p>') == "a\nb"
    assert main_text("<p>a</p><!-- <script> --><p>b</p><script>c</script><p>d</p>") == "a\nb\nd"
    assert main_text("<p>a</p><!-- never closed <script>x</script><p>b</p>") == "a"


def test_role_words_around_the_text():
    text, side = (LONG * 2).strip(), "<div class=comments><p>Nice.</p></div>"
    for open_, end in (('<div class="site no-sidebar">', "</div>"), ('<div class="content has-sidebar">', "</div>"),
                       ('<section id="search-result-7">', "</section>"), ("<form action=x>", "</form>"), ('<div class="with-left-menu">', "</div>"),
                       ('<form><div class="widget"><div id="page-header">', "</div></div></form>")):
        assert main_text(f"<body>{open_}<p>{text}</p><p>{text}</p>{side}{end}</body>").split("\n") == [text, text], open_
        assert main_text(f"<body>{open_}<article><p>Short.</p>{side}</article>{end}</body>") == "Short.", open_
        assert main_text(f"<body><article>{open_}<p>{text}</p>{side}{end}</article></body>") == text, open_
    several = "".join(f'<section id="search-result-{i}"><p>{text} {i}</p></section>' for i in range(3))
    assert main_text(several).split("\n") == [f"{text} {i}" for i in range(3)]


def test_role_words_beside_the_text():
    text, main = (LONG * 2).strip(), "<p>" + LONG * 4 + "</p>"
    for beside in (f"<section id=comments><p>{text}</p></section>", f"<div class=related><article><p>{text}</p></article></div>",
                   f'<div class="left-sidebar"><p>{text}</p></div>', f"<form><p>{text}</p></form>"):
        assert main_text(f"<body>{main}{beside}</body>") == main_text(f"<body><article>{main}</article>{beside}</body>") == (LONG * 4).strip()
    assert main_text(f"<body><div class=widget>{main}<div class=share>Share</div><aside>{main}</aside></div></body>") == (LONG * 4).strip()


def test_paragraph_that_begins_with_copyright():
    text = "Copyright is a part of the law that " + LONG * 2
    assert main_text(f"<body><p>{LONG * 2}</p><p>{text}</p><p>Copyright 2020 by me</p></body>").split("\n") == [(LONG * 2).strip(), text.strip()]


def test_articles_of_the_pages(spark, sf):
    """Brute force: in these pages the article element holds blocks h1 and p only."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        body = re.sub(r"<[^>]*\Z", "", body)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p))).split()) for p in re.split(r"</?(?:h1|p)>", body)]
        want = "\n".join(p for p in parts if p)
        assert got[r["page_id"]] == (want, len(want))


def test_tables(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, extract(pages).collect())) == sorted(
        ["Row(page_id=1, url='u', text='a', n_chars=1)"] * 2 + ["Row(page_id=None, url=None, text='', n_chars=0)"])
    assert extract(pages.limit(0)).count() == 0


def test_comments_and_notices_go_whatever_their_length():
    post, talk = "<p>A post of one paragraph that says what there is to say and is then done with it.</p>", f"<p>{LONG * 2}</p>" * 3
    for name in ("class=comments", 'id="disqus_thread"', 'class="cookie-notice big"', "class=left-sidebar", "class=advert"):
        for page in (f"<body>{post}<div {name}>{talk}</div></body>", f"<body><article>{post}<section {name}>{talk}</section></article></body>",
                     f"<body><div {name}><article>{talk}</article></div><main>{post}</main></body>"):
            assert main_text(page) == post[3:-4], page


def test_attributes_as_a_browser_reads_them():
    assert main_text("<p class=it's>One.</p><article><p title=a'b>Two 'x'.</p></article>") == "One.\nTwo 'x'."
    assert main_text("<p title='a > b' data-x = \"c > 'd\">One.</p>") == "One."
    assert main_text('<p title="never closed>One.</p><p>Two.</p>') == "One.\nTwo."


def test_links_inside_articles_stay():
    page = "<article><p>Text.</p><p><a href=1>The whole paragraph is a link</a></p><ul><li><a href=2>Source</a><li><a href=3>Other</a></ul></article>"
    assert main_text(page).split("\n") == ["Text.", "The whole paragraph is a link", "Source", "Other"]


def test_broken_markup_takes_linear_time():
    for page in ("<a" * 500_000, "<script" * 150_000, '<a b="' * 170_000 + ">", "<div>" * 60_000 + "</span>" * 60_000 + "x",
                 "<p><div>" * 60_000 + "<p>" * 60_000, "<!" * 400_000, "<b>" * 100_000 + "<p>" * 100_000, "='" * 400_000 + "<a ='" + "='" * 400_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 3, page[:20]
