import random
import time

import pytest

from credence.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text string, path int, host string"


def words(rng, n):
    return " ".join(rng.choice(["Über", "of", "the", "ther,", "a", "&amp;", "x&lt;y", "caf&eacute;",
                                "1&nbsp;2"]) for _ in range(n))


def shown(text):
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&eacute;", "é"), ("&nbsp;", " ")):
        text = text.replace(a, b)
    return text


def page(rng, layout):
    """A page and the text of its article."""
    title, paragraphs = words(rng, 5), [words(rng, rng.randint(4, 60)) for _ in range(
        rng.randint(2, 9))]
    blocks, inner = [title, *paragraphs], f"<h1>{title}</h1>"
    for i, p in enumerate(paragraphs):
        form = rng.randrange(5)
        if form == 0:
            inner += f"<p>{p}</p>\n"
        elif form == 1:
            inner += f"<p><b>{p}<br><p>"
        elif form == 2:
            inner += f"<ul><li>{p}</ul>"
        elif form == 3:
            inner += f"<div class=para><i>{p.replace(' ', chr(10), 1)}</i></div>"
        else:
            inner += f"<blockquote title='>'>{p}</blockquote><script>var a='<p>no</p>';</script>"
    links = "".join(f"<li><a href='/{i}'>{words(rng, 3)}</a></li>" for i in range(8))
    noise = words(rng, 12)
    comments = f"<div class='comment-list' id=c><p>{noise}</p><p>{words(rng, 40)}</p></div>"
    body = {
        "article": f"<nav><ul>{links}</ul></nav><div class=ad>{noise}</div><article>{inner}"
                   f"<aside>{noise}</aside>{comments}</article><footer>&copy; {noise}</footer>",
        "div": f"<header><h2>{noise}</h2></header><div class='page p{rng.randrange(99)}'>"
               f"<div class='content wide'>{inner}</div><div class=sidebar-left>{noise}"
               f"<ul>{links}</ul></div></div><div id=cookie-notice><p>{words(rng, 30)}</p></div>",
        "main": f"<div class=wrap><main class='has-sidebar'>{inner}<form><label>{noise}"
                f"</label></form></main>{comments}</div><div hidden>{noise}</div>",
    }[layout]
    html = f"<!DOCTYPE html><html><head><title>{noise}</title><style>p{{}}</style></head>" \
           f"<body><!-- <article>{noise}</article> -->{body}</body></html>"
    return html, "\n".join(" ".join(shown(b).split()) for b in blocks)


@pytest.mark.parametrize("layout", ["article", "div", "main"])
def test_layouts(layout):
    rng = random.Random(4)
    for _ in range(60):
        html, text = page(rng, layout)
        assert H.main_text(html) == text
        assert H.main_text(html, H.Page(html).vote()) == text
        cut = html[:html.index("</body>")]
        assert H.main_text(cut) == text


def test_consensus_path_decides_for_a_page_that_scores_otherwise(spark):
    """A page whose boilerplate is longer than its article is read with the path of its host."""
    rng = random.Random(1)
    rows, expected = [], {}
    for i in range(12):
        html, text = page(rng, "div")
        rows.append((i, f"https://A.example/x/{i}", html, "clash", 0, "h"))
        expected[i] = text
    html = ("<html><body><div class='page p3'><div class='content wide'><h1>T</h1><p>short text"
            "</p></div></div><div class=extra>" + "<p>long unmarked rubbish</p>" * 50
            + "</div></body></html>")
    assert "rubbish" in H.main_text(html)
    rows.append((50, "https://a.example/other", html, "", 0, ""))
    expected[50] = "T\nshort text"
    for i in range(60, 66):
        html, text = page(rng, "article")
        rows.append((i, "http://b.example", html, "", 0, ""))
        expected[i] = text
    rows += [(70, None, None, None, None, None), (71, "http://b.example/", "", "", 0, ""),
             rows[0], (72, None, "<p>no url</p>", "", 0, ""),
             (73, "http://c/", "<p>" + "very long " * 100_000, "", 0, "")]
    expected |= {70: "", 71: "", 72: "no url", 73: ("very long " * 100_000).strip()}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = H.extract(df).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert r.text == expected[r.page_id], r.page_id
    paths = {r.host_path for r in got if r.url and "a.example" in r.url.lower()}
    assert paths == {"html/body/div.p#.page/div.content.wide"}


def test_odd_markup():
    assert H.main_text("a < b &copy x<br>y</p>z") == "a < b © x y z"
    assert H.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert H.main_text("<p>a</b></i>b<dl><dt>c<dd>d<dt>e</dl>") == "ab\nc\nd\ne"
    assert H.main_text("<p title='a>b' x=\">\">c</p><!-- d") == "c"
    assert H.main_text("<script>no<p>no</p>") == "" and H.main_text("") == ""
    assert H.main_text("<textarea><p>no</textarea><p>yes <span class=ad>no</span>&#x41;") == \
        "yes A"
    assert H.main_text("<article><header><h1>A</h1></header><p>b</article>") == "A\nb"


PARAGRAPHS = [f"Paragraph {i} of the article has a number of words that make one sentence."
              for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WHOLE = "\n".join(["Title", *PARAGRAPHS])


@pytest.mark.parametrize("wrapper", [
    "<form id=aspnetForm><label>Search</label>{}</form>", "<div class='header-fixed'>{}</div>",
    "<div class='page-widget'>{}</div>", "<header>{}</header>",
    "<form><div class=widget><div id=main-header>{}</div></div></form><p>made by x</p>"])
def test_a_wrapper_is_no_boilerplate(wrapper):
    noise = ("<nav><a href=/>home</a></nav><div class=comments><p>" + "I say a long thing. " * 60
             + "</p></div><form><p>Write to us</p><input></form><div class=cookie-notice>"
             "<p>We use cookies on this site for many good reasons.</p></div>")
    html = f"<html><body>{wrapper.format('<h1>Title</h1>' + BODY + noise)}</body></html>"
    assert H.main_text(html) == WHOLE or H.main_text(html) == WHOLE + "\nmade by x"


@pytest.mark.parametrize("box", [
    "<form>{}</form>", "<header>{}</header>", "<div class=widget>{}</div>"])
def test_long_boilerplate_beside_the_article_is_none_of_it(box):
    """It has more sentences, but the first heading is outside."""
    html = "<body><div id=c><h1>Title</h1><p>Short.</p></div>" + box.format(BODY) + "</body>"
    assert H.main_text(html) == "Title\nShort."
    assert H.main_text("<body>" + box.format("<b>Log in</b> name") + "</body>") == ""


def test_lead_and_closing_paragraphs():
    inner = f"<div class=text>{BODY}</div>"
    html = f"<body><div class=content><p>Lead.</p>{inner}<p>Closing.</p></div><div>x y</div></body>"
    assert H.main_text(html) == "\n".join(["Lead.", *PARAGRAPHS, "Closing."])
    assert H.Page(html).vote() == "html/body/div.content".removeprefix("html/")
    quote = f"<body><div><p>Before.</p><blockquote>{BODY}</blockquote><p>After.</p></div></body>"
    assert H.main_text(quote) == "\n".join(["Before.", *PARAGRAPHS, "After."])


def test_article_headers_and_discussions():
    head = "<div class='article-header'><h1>Title</h1><p>A lead.</p></div>"
    assert H.main_text(f"<body><div class=c>{head}{BODY}</div></body>") == \
        WHOLE.replace("Title", "Title\nA lead.")
    part = f"<section id=discussion><h2>Discussion</h2>{BODY}</section>"
    assert H.main_text(f"<article><h1>Title</h1>{BODY}{part}</article>") == "\n".join(
        [WHOLE, "Discussion", *PARAGRAPHS])
    readers = "<section id=discussion><div class=comment><p>No!</p></div><p>Yes</p></section>"
    assert H.main_text(f"<article><h1>Title</h1>{BODY}{readers}</article>") == WHOLE


def test_a_small_box_on_the_path_of_the_host_is_no_article():
    html = f"<body><div class=box>ok</div><div class=other><h1>Title</h1>{BODY}</div></body>"
    assert H.main_text(html, "body/div.box") == WHOLE
    assert H.main_text(html, "body/div.none") == WHOLE
    assert H.main_text(html, "body/div.other") == WHOLE


def test_many_nested_and_sibling_wrappers():
    deep = "<div class=widget>" * 400 + BODY + "</div>" * 400
    assert H.main_text(f"<body>{deep}</body>") == "\n".join(PARAGRAPHS)
    two = f"<body><div class=widget>{BODY}{BODY}</div><div class=widget>{BODY}</div></body>"
    assert H.main_text(two) == "\n".join(PARAGRAPHS * 2)


@pytest.mark.parametrize("html", [
    "<" * 200_000, "<a href='" * 50_000, "<div>" * 30_000 + "x", "<i>" * 30_000 + "</b>" * 30_000,
    "<p><b>" * 30_000 + "y", "<td>" * 30_000, "&" * 200_000, "<script>" * 30_000,
    "<!--" * 50_000, "<div class=widget><form>" * 15_000, "<form>a b c d e f g h</form>" * 15_000, "<li><i>" * 20_000, "<title>" * 30_000, "<div class='a b'><p>t" * 20_000])
def test_time_is_linear_for_broken_pages(html):
    begin = time.process_time()
    H.main_text(html)
    assert time.process_time() - begin < 8


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0
