import html
import random
import re

import pyarrow.parquet as pq
import pytest

from quarrylens.llm import html_extraction as X
from quarrylens.llm.html_extraction import extract_pages, main_text, runs

from ..conftest import SF

ARTICLE = "<article><h1>Title</h1><p>One  <b>two</b>\n three.<p>Fish &amp; chips &#233; &lt;b&gt;</p><ul><li>a<li>b</ul></article>"
TEXT = "Title\nOne two three.\nFish & chips é <b>\na\nb"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>{ARTICLE}<footer>&copy; me</footer></body></html>",
        f'<body><script>var t="</p><article>";</script><div class="ad">Buy now, a long advert text that goes on.</div>{ARTICLE}<div class="sidebar"><p>Side text that is quite long, longer than the article perhaps, for sure.</p></div>',
        f"<header><h1>Site</h1></header><form><p>Search</p></form>{ARTICLE}<section id=comments><p>First!</p></section>",
        f'<div class="cookie-notice">We use cookies</div><!-- <article> -->{ARTICLE}<aside>Also</aside>',
        ARTICLE.replace("<article>", '<div id="content">').replace("</article>", "</div>") + '<div class="footer-links">x y z</div>',
        ARTICLE.replace("</ul></article>", "</ul>"),
        ARTICLE.replace("<p>Fish", '<div class="ad"><p>Buy</p></div><p>Fish').replace("</article>", '<ol class="comment-list"><li>Nice</ol></article><p>after'),
        f'<main>{ARTICLE}</main><div style="display: none">hidden</div><div hidden>too</div><p',
        ARTICLE.replace("<p>Fish", "<table hidden><tr><td>x</table><p title='a>b'>Fish"),
    ],
)
def test_article_alone(page):
    assert main_text(page) == TEXT


def test_without_article_the_longest_run_is_kept():
    long = "".join(f"<p>Paragraph {i} with a good number of words in it.</p>" for i in range(5))
    page = f"<div><a href=1>one</a></div><div><a href=2>two</a></div><div><a href=3>three</a></div><div>{long}</div><div><a href=4>four</a></div><div><a href=5>five</a></div><div><a href=6>six</a></div><div>tiny</div>"
    assert main_text(page) == "\n".join(f"Paragraph {i} with a good number of words in it." for i in range(5))


def test_surge_and_dive():
    assert runs([0, 5, 0, 0, 7, 0, 0, 0, 2, 0]) == [(1, 5), (8, 9)]
    assert runs([]) == [] and runs([0, 0]) == [] and runs([1]) == [(0, 1)]


def test_brute_force_window_sums():
    import itertools

    for n in range(1, 8):
        for lengths in itertools.product((0, 3), repeat=n):
            kept = {i for a, b in runs(list(lengths)) for i in range(a, b)}
            ones = [i for i in range(n) if lengths[i]]
            want = set(ones)
            for a, b in zip(ones, ones[1:]):
                if b - a <= 3:  # some window of three always holds text between the two
                    want |= set(range(a, b))
            assert kept == want, lengths


def test_defined_cases(spark):
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (3, None, "plain", "t"), (3, None, "plain", "t"), (None, "u", "<p>" + "x " * 100_000, "t"), (5, "u", "<nav>only", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_pages(pages)
    assert got.columns == ["page_id", "url", "html", "text", "_text", "n_chars"]
    by = {r.page_id: r for r in got.collect()}
    assert (by[1]._text, by[2]._text, by[3]._text, by[5]._text) == ("", "", "plain", "") and by[None].n_chars == 199_999
    assert got.count() == 6 and extract_pages(pages.where("false")).count() == 0


def test_unclosed_markup_takes_linear_time():
    assert main_text("<div " * 20_000 + "x") == "" and isinstance(main_text("<a title='" * 5000), str)
    assert main_text("<b>" * 50_000 + "text") == "text"


@pytest.mark.parametrize("head", ["<html><head><title>x</title><body>", "<head><meta charset=utf-8><noscript><img src=x></noscript><link rel=a>", "<head><title>x</title></head>"])
def test_head_ends_without_its_end_tag(head):
    assert main_text(head + ARTICLE) == TEXT and main_text(head + "Some text") == "Some text"


@pytest.mark.parametrize("name", "button select svg math object audio video canvas noscript template".split())
def test_unclosed_elements_swallow_no_article(name):
    for page in (f"<body><{name} id=x>{ARTICLE}", f"<div><{name}></div>{ARTICLE}<{name}>Go</{name}>", ARTICLE.replace("<p>Fish", f"<{name}><p>Fish")):
        assert main_text(page) == TEXT
    assert main_text(f"<article><p>One <{name}>x<option>y</{name}> two <{name}></{name}>three</article>") == "One two three"


def test_held_elements_take_linear_time():
    assert main_text("<select>" + "<option>x" * 50_000 + "</select>text") == "text" and main_text("<svg>" * 50_000 + "<p>text") == "text"


@pytest.mark.parametrize("tags", ["div", "body", "section"])
def test_an_advert_does_not_part_the_opening_from_the_body(tags):
    long = "".join(f"<p>Paragraph {i} with a good number of words in it.</p>" for i in range(9))
    lines = "\n".join(f"Paragraph {i} with a good number of words in it." for i in range(9))
    ad, menu = '<div class="ad">Buy now</div>', "".join(f"<li><a href={i}>to page {i}</a>" for i in range(4))
    assert main_text(f"<{tags}><h1>Title</h1><p>Opening.</p>{ad}{long}{ad}<p>End.</p>{ad}Last.</{tags}>") == f"Title\nOpening.\n{lines}\nEnd.\nLast."
    assert main_text(f"<div><div>Slogan</div></div><nav>x</nav><{tags}>{long}</{tags}><ul>{menu}</ul><div>tiny</div>") == lines


def by_pattern(page):
    """The text of an article whose page has one, by patterns alone."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", body, flags=re.S)
    blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|pre|table|tr|td)\b[^>]*>", body)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_whole_pages_by_brute_force():
    for row in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        assert X.main_text(row["html"]) == by_pattern(row["html"])


@pytest.mark.parametrize("table", [SF, "/root/testdata/sf0.01"])
def test_pages_stripped_of_all_names_by_line_lengths_alone(table):
    kept = chars = adverts = pages = 0
    for row in pq.read_table(f"{table}/pages.parquet").to_pylist():
        page = row["html"]
        menu = [html.unescape(x) for x in re.findall(r"<li><a[^>]*>(.*?)</a>", page)]
        advert = html.unescape(re.search(r'<div class="ad">(.*?)</div>', page, re.S)[1])
        bare = re.sub(r"<(/?)(?:article|main|nav|footer|header|aside)\b[^>]*>", r"<\1div>", page)
        bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]*)", "", bare)
        want, got = by_pattern(page).split("\n"), X.main_text(bare).split("\n")
        left = list(got)
        for line in want:
            chars += len(line)
            if line in left:
                left.remove(line)
                kept += len(line)
        assert not set(menu) & set(left), page
        adverts += " ".join(advert.split()) in left
        pages += 1
    assert kept >= 0.95 * chars and adverts <= 0.2 * pages


LONG = "".join(f"<p>Paragraph {i} with a good number of words in it.</p>" for i in range(9))
LINES = "\n".join(f"Paragraph {i} with a good number of words in it." for i in range(9))


@pytest.mark.parametrize(
    "part,text",
    [
        ('<p class="no-comment">No comment was given.</p>', "No comment was given."),
        ('<p id="ad-hoc">An ad hoc remark, short.</p>', "An ad hoc remark, short."),
        ('<p id="ad-hoc">Ad hoc</p>', "Ad hoc"),
        ('<section id="login-flow"><h2>Login flow</h2><p>The user opens the page.</p></section>', "Login flow\nThe user opens the page."),
        ('<div class="modal-logic">Modal logic is about what must be.</div>', "Modal logic is about what must be."),
        ('<div class="notice"><p>Notice that this is prose.</p></div>', "Notice that this is prose."),
        ('<div class="comment-analysis"><p>Comments were counted.</p></div>', "Comments were counted."),
        ('<h2 class="share">The share of labour</h2>', "The share of labour"),
        ('<div class="widget">Widgets are made here, as they were.</div>', "Widgets are made here, as they were."),
        ('<p>See <a href="x">the whole report of that year</a></p>', "See the whole report of that year"),
    ],
)
def test_names_alone_cut_nothing_inside_an_article(part, text):
    for tag in ("article", "main"):
        assert main_text(f"<{tag}><h1>T</h1>{LONG}{part}<p>End.</p></{tag}>") == f"T\n{LINES}\n{text}\nEnd."
        assert main_text(f"<{tag}>{part}{LONG}</{tag}>") == f"{text}\n{LINES}"


@pytest.mark.parametrize(
    "part",
    [
        '<div class="ad"><p>Buy this now, it is cheap today.</p></div>',
        '<div class="ad-slot">Buy now</div>',
        '<ul class="share-buttons"><li>Mail<li>Print</ul>',
        '<div class="related-posts"><a href=1>One other post.</a><a href=2>And one more.</a></div>',
        '<div class="newsletter"><p>Get our letter.</p><input name=mail><button>Go</button></div>',
        '<div class="sidebar"><p>About the author, who lives by the sea.</p></div>',
        '<div id="cookie-banner"><p>We use cookies on this site.</p></div>',
    ],
)
def test_names_are_believed_of_what_looks_the_part(part):
    assert main_text(f"<article>{LONG}{part}<p>End.</p></article>") == f"{LINES}\nEnd."
    assert main_text(f"<article>{LONG}</article>{part}") == LINES
    assert main_text(f"<div>{LONG}{part}<p>End.</p></div>") == f"{LINES}\nEnd."


def test_reader_comments_longer_than_the_article():
    comments = "".join(f'<div class="comment"><p>I thought so too, number {i}, and said it at length.</p></div>' for i in range(40))
    for name in ("comments", "comment-list", "post-comments"):
        assert main_text(f'<article><h1>T</h1><p>It is short.</p><section class="{name}"><h2>40 comments</h2>{comments}</section></article>') == "T\nIt is short."


def test_titles_leads_and_ends_apart_from_the_body():
    links = "".join(f"<div><a href={i}>Go to page {i}</a></div>" for i in range(4))
    assert main_text(f"<body><h1>Title</h1><p>Short lead.</p>{links}{LONG}{links}<p>Last words.</p></body>") == f"Title\nShort lead.\n{LINES}\nLast words."
    assert main_text(f"<body><h1>Title</h1><p>Short lead.</p>{links}<div>{LONG}</div>{links}<p>Last words.</p></body>") == f"Title\nShort lead.\n{LINES}\nLast words."


def test_a_name_does_not_beat_a_long_text():
    got = main_text(f'<div class="content">One line.</div><hr><ul>{"<li><a href=1>Link</a>" * 5}</ul><div class="q">{LONG}</div>')
    assert LINES in got
    assert LINES in main_text(f"<article>A card.</article><div>{LONG * 3}</div>")
    assert main_text(f'<div class="widget">{LONG}</div>') == LINES


def test_pages_without_telling_names():
    r = random.Random(4)
    for _ in range(200):
        words = lambda n: " ".join(r.choice(["river", "stone", "cloud", "&amp;", "tree"]) for _ in range(n))
        menu = "".join(f'<li><a href="/{k}">{words(2)}</a></li>' for k in range(r.randrange(3, 9)))
        text = [words(r.randrange(20, 60)) for _ in range(r.randrange(4, 9))]
        end = "".join(f'<div class="x{k}"><a href="/{k}">{words(5)}</a> |</div>' for k in range(r.randrange(1, 4)))
        page = f"<html><body><div class=q1><ul>{menu}</ul></div><div class=q2>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=q3>{end}</div></body></html>"
        assert X.main_text(page) == "\n".join(t.replace("&amp;", "&") for t in text)


def test_doubtful_names_inside_an_article():
    work = "<div class='related work'><p>Related work is a section of prose.</p></div>"
    page = f"<main><p>One text.</p>{work}<div class=related><a href=x>more</a> <a href=y>of this</a></div><div class=search>Find <input name=q> it all here now.</div><section class=share>Share this</section><p>End.</p></main>"
    assert X.main_text(page) == "One text.\nRelated work is a section of prose.\nEnd."
    assert X.main_text(page.replace("main>", "div>")) == "One text.\nEnd."
