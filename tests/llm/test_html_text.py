"""Main text against the texts that pages are built from."""

import html
import math
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st

from vigilog.llm.html_text import extracted, main_text, tree, _measure

LONG = "The river ran low that summer and the mill stood still for weeks on end, so the miller told anyone who would listen."
PARAGRAPHS = [LONG, "Short one.", f"{LONG} {LONG}", "Fish & chips < 5 pounds, the sign said.", LONG[:70]]


def body(inner):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p><p>x';</script></head><body>{inner}</body></html>"


def paragraphs(texts):
    return "".join(f"<p>{html.escape(t)}</p>" for t in texts)


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News and more news</a></li></ul></nav>'
SIDE = '<div class="sidebar"><p>Most read: ' + LONG + "</p></div>"
COMMENTS = f'<section id="comments"><h3>Comments</h3><div class="comment"><p>{LONG} I agree!</p></div></section>'
FORM = '<form><label>Your mail</label><input name="m"><button>Send it now</button></form>'
WANTED = "\n".join(PARAGRAPHS)


@pytest.mark.parametrize(
    "page",
    [
        body(NAV + '<div class="ad">Buy this!</div><article>' + paragraphs(PARAGRAPHS) + "</article>" + COMMENTS + "<footer>&copy; me</footer>"),
        body("<header><h1>Site</h1></header>" + NAV + "<main>" + paragraphs(PARAGRAPHS) + FORM + "</main>" + SIDE),
        body('<div id="wrap"><div id="menu"><a href="/x">x</a></div><div class="content">' + paragraphs(PARAGRAPHS) + "</div><aside>" + paragraphs([LONG]) + "</aside></div>"),
        body(NAV + "<div><div>" + paragraphs(PARAGRAPHS) + "</div><div>" + "".join(f'<a href="/{i}">Related story number {i}</a> ' for i in range(9)) + "</div></div>"),
        body("<article>" + paragraphs(PARAGRAPHS[:2]) + '<div class="cookie-notice"><p>We use cookies.</p></div>' + paragraphs(PARAGRAPHS[2:]) + "</article>"),
        "<body><article>" + "".join(f"<p><b>{html.escape(t)}<br>" for t in PARAGRAPHS),
        body("<article>" + "<br><br>".join(html.escape(t) for t in PARAGRAPHS) + "</article>"),
        body("<article><!-- no --><p hidden>secret</p>" + "".join(f"<p>\n {html.escape(t[:10])}<em>{html.escape(t[10:])}</em>\t</p>" for t in PARAGRAPHS) + "</article>"),
    ],
)
def test_article_text(page):
    assert main_text(page) == WANTED


def text_of(n, letter="x"):
    return ((letter * 9 + " ") * n)[: n - 1] + "."


def test_whole_article_beside_its_densest_part():
    heading, paragraph = text_of(40), text_of(400)
    inner = "<div>" + paragraphs([paragraph] * 4) + "</div>"
    wanted = "\n".join([heading] + [paragraph] * 4)
    assert main_text(body(f"{NAV}<article><h1>{heading}</h1>{inner}</article>{SIDE}")) == wanted
    assert main_text(body(f'<main><h1><a href="/t">{heading}</a></h1>{inner}</main>')) == wanted


def test_sections_of_unlike_length():
    first, second = [text_of(500)] * 5, [text_of(350, "y")] * 5
    sections = f"<section>{paragraphs(first)}</section><section>{paragraphs(second)}</section>"
    assert main_text(body(f"<article>{sections}</article>")) == "\n".join(first + second)


def test_loose_text_beside_the_best_part():
    paragraph = text_of(400)
    inner = "<div>" + paragraphs([paragraph] * 4) + "</div>"
    wanted = "\n".join(["Loose words before.", *[paragraph] * 4, "And after."])
    assert main_text(body(f"<article>Loose words before.{inner}And after.</article>")) == wanted
    assert main_text(body(f"<div>Loose words before.{inner}And after.</div>")) == wanted
    assert main_text(body(f'<div>Loose words before.{inner}And after.<br><a href="/">All the other stories</a></div>')) == wanted
    assert main_text(body(f"Home of the site.<article>{inner}</article>")) == "\n".join([paragraph] * 4)
    assert main_text("<div>" * 3000 + "Loose words before." + inner + "And after.") == wanted


@pytest.mark.parametrize(
    "page",
    [
        body(NAV + '<div class="content-sidebar-wrap"><article>' + paragraphs(PARAGRAPHS) + "</article>" + SIDE + "</div>"),
        body(NAV + '<div class="site has-sidebar"><main>' + paragraphs(PARAGRAPHS) + "</main>" + SIDE + "</div>"),
        body('<div class="site has-sidebar"><div class="content">' + paragraphs(PARAGRAPHS) + "</div></div>"),
        body('<form id="aspnetForm" action="/"><input type="hidden" name="v"><div>' + paragraphs(PARAGRAPHS) + "</div>" + NAV + "</form>"),
        body('<div class="alert-page"><form><div class="widget">' + paragraphs(PARAGRAPHS) + "</div></form></div>"),
        body("<main><article>" + paragraphs(PARAGRAPHS) + "</article>" + COMMENTS * 40 + "</main>"),
        body("<article>" + paragraphs(PARAGRAPHS) + '<section class="comments">' + f"<article><p>{LONG}</p></article>" * 2 + "</section></article>"),
        body("<article>" + paragraphs(PARAGRAPHS) + FORM + "</article>" + f'<div class="related"><article class="teaser comment">{LONG}</article></div>'),
    ],
)
def test_wrappers_are_no_noise(page):
    assert main_text(page) == WANTED


def test_code_keeps_its_comments():
    code = '<pre><code><span class="hljs-comment"># sums</span> s = 0 <span class="token comment"># here</span></code></pre>'
    assert main_text(body("<article>" + paragraphs([LONG]) + code + '<span class="x" hidden>no</span></article>')) == LONG + "\n# sums s = 0 # here"


def test_references():
    assert main_text("<article><p>a&amp;b &lt;i&gt; &#233;&nbsp;&copy 1 &am</p></article>") == "a&b <i> é © 1 &am"


@pytest.mark.parametrize(
    "page",
    [
        "<article><p>x</p><div data-x='" + "{\"k\":\"v\"," * 100_000,
        "<article><p>x</p><a " + '"q" ' * 250_000,
        "<article><p>x</p>" + '<a "' * 250_000,
        "<article><p>x</p>" + "<!" * 500_000,
        "<article><p>x</p><script>" + "</script " * 100_000,
        "<article><p>x</p>" + "<a b='" * 150_000,
    ],
)
def test_malformed_pages_take_linear_time(page):
    begin = time.process_time()
    assert main_text(page) == "x"
    assert time.process_time() - begin < 1.5


def test_quotes_outside_values_and_tags_without_an_end():
    assert main_text("<article><p it's>one</p><p title=\"a > b\">it's two</p></article>") == "one\nit's two"
    assert main_text("<article><p>one</p><p title='x>two</p><p>three</p></article>") == "one\ntwo\nthree"


@pytest.mark.parametrize("name", ['class="social-science"', 'class="related-work"', 'class="notice-board"', 'id="search-algorithms"', 'class="x comment-on-politics"'])
def test_names_that_only_hold_a_word_of_noise(name):
    inner = f"<p>{LONG}</p><div {name}><p>{LONG}</p></div><p>{LONG}</p>"
    assert main_text(body(f"<article>{inner}</article>")) == main_text(body(f"<div>{inner}</div>")) == "\n".join([LONG] * 3)


@pytest.mark.parametrize("tag", ["math", "fieldset", "object", "noscript"])
def test_elements_that_are_kept(tag):
    assert main_text(body(f"<article><p>{LONG}</p><{tag}>a = b</{tag}></article>")) == LONG + "\na = b"


def test_controls_do_not_cut_a_line():
    assert main_text(body(f"<article><p>{LONG} <button>Copy</button>{LONG}</p></article>")) == f"{LONG} {LONG}"


def test_headline_and_short_section_without_an_article_element():
    two = "<div>" + paragraphs([LONG * 3] * 2) + "</div>"
    assert main_text(body(NAV + f"<div><h1>Headline</h1>{two}</div>")) == "\n".join(["Headline", *[LONG * 3] * 2])
    assert main_text(body(NAV + f'<div><div class="top"><h1>Headline</h1></div>{two}</div>')) == "\n".join(["Headline", *[LONG * 3] * 2])
    sections = f"<section>{paragraphs([LONG * 3] * 5)}</section><section><p>Short.</p></section>"
    assert main_text(body(NAV + f"<div>{sections}</div>")) == "\n".join([*[LONG * 3] * 5, "Short."])


class Twin(HTMLParser):
    """Well-formed pages as nested lists [tag, children]; inline tags are marks in the text."""

    def __init__(self):
        super().__init__()
        self.open = [["body", []]]

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b"):
            self.open[-1][1].append(("<", tag))
        elif tag not in ("body", "html"):
            node = [tag, []]
            self.open[-1][1].append(node)
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in ("a", "b"):
            self.open[-1][1].append((">", tag))
        elif tag not in ("body", "html"):
            self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def measured(node):
    """(characters, tags, characters in links, link tags) of a subtree, counted anew at every call."""
    chars = tags = linked = link_tags = 0
    inside, run, link_run = False, "", ""
    for x in [*node[1], ["", []]]:
        if isinstance(x, list):
            run, link_run = " ".join(run.split()), " ".join(link_run.split())
            chars, linked = chars + len(run), linked + min(len(run), len(link_run))
            run = link_run = ""
            inside = False
            if x[0]:
                own = measured(x)
                chars, tags, linked, link_tags = chars + own[0], tags + own[1] + 1, linked + own[2], link_tags + own[3]
        elif isinstance(x, tuple):
            if x[0] == "<":
                tags += 1
                link_tags += x[1] == "a"
            inside = (x[0] == "<") if x[1] == "a" else inside
        else:
            run += x
            link_run += x if inside else ""
    return chars, tags, linked, link_tags


def density(node, page):
    chars, tags, linked, link_tags = measured(node)
    if not chars:
        return 0.0
    whole = measured(page)
    base = math.log(chars / max(chars - linked, 1) * linked + whole[2] / max(whole[0], 1) * chars + math.e)
    return chars / max(tags, 1) * math.log(max(chars / max(linked, 1) * max(tags, 1) / max(link_tags, 1), 1) + 1) / math.log(base + 1)


def sums(node, page):
    runs, run, own = 0, "", 0.0
    for x in [*node[1], ["", []]]:
        if isinstance(x, list):
            runs += len(" ".join(run.split()))
            run = ""
            own += density(x, page) if x[0] else 0.0
        elif isinstance(x, str):
            run += x
    return own + runs


_text = st.sampled_from(["word ", "two words ", LONG, LONG * 2, "Home "])
_line = st.lists(st.one_of(_text, _text.map(lambda t: f"<a href='/'>{t}</a>"), _text.map(lambda t: f"<b>{t}</b>")), min_size=1, max_size=3).map("".join)
_html = st.recursive(_line.map(lambda t: f"<p>{t}</p>"), lambda inner: st.lists(inner, min_size=1, max_size=4).map(lambda x: f"<div>{''.join(x)}</div>"), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(_html, min_size=1, max_size=4).map(lambda x: "<body>" + "".join(x) + "</body>"))
def test_densities_and_sums_are_those_counted_anew(page):
    twin = Twin()
    twin.feed(page)
    whole = twin.open[0]
    flat, nodes = [whole], _measure(tree(page))
    for node in flat:
        flat += [x for x in node[1] if isinstance(x, list)]
    assert len(flat) == len(nodes)
    for a, b in zip(flat, nodes, strict=True):
        assert (a[0], *measured(a)) == (b.tag, b.chars, b.tags, b.link_chars, b.link_tags)
        assert b.total == pytest.approx(sums(a, whole)) and b.density == pytest.approx(density(a, whole))
    best = max(flat, key=lambda n: sums(n, whole))
    words = [w for w in re.sub(r"<[^>]*>", " ", "".join(_flat_text(best))).split()]
    text = main_text(page).split()
    assert all(text.count(w) >= words.count(w) for w in words)


def _flat_text(node):
    for x in node[1]:
        if isinstance(x, list):
            yield " "
            yield from _flat_text(x)
            yield " "
        elif isinstance(x, str):
            yield x


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p>", "<html><body></body></html>", "<script>x", "<nav><p>x</p></nav>", "</p></div>", "<!-- open"])
def test_empty_pages(page):
    assert main_text(page) in ("", "<")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<a href='x'>", "</a>", "<b>", "text", " &amp; ", "<td>", "<table>", "</table>", "<br>", "<nav>", "</nav>", "<!--", "-->", "<x a=\"", "'>", "</article>", "<article>"]), max_size=25))
def test_any_markup_gives_text_without_loss_of_counts(parts):
    page = "".join(parts)
    root = tree(page)
    nodes = _measure(root)
    assert root.chars == sum(len(c) for n in nodes for c in n.children if isinstance(c, str))
    assert "\n\n" not in main_text(page)


def test_long_and_deep_pages():
    assert len(main_text("<article>" + "<div>" * 3000 + "<p>" + "word " * 200_000 + "</p>")) == 999_999


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r["page_id"]: r for r in extracted(pages.unionAll(pages)).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", inner)]
        assert rows[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])


def test_null_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, None, "z"), (1, "u", "<p>hi</p>", "z")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in extracted(df).collect()) == [("", 0), ("hi", 2)]
    assert extracted(df.limit(0)).count() == 0
