import re
from html import unescape

from tarnfield.llm import html
from tarnfield.sources import read_table

SF = "/root/testdata/sf0.01"


def article(page):
    """The blocks between the article tags, cut by pattern."""
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    return "\n".join(b for b in blocks if b)


def test_every_page_gives_its_article(spark):
    pages = {r.page_id: (r.url, article(r.html)) for r in read_table(spark, SF, "pages").collect()}
    got = {r.page_id: (r.url, r.text) for r in html.op7_html_text(spark, SF).collect()}
    assert got == pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
<body><header class="site-header"><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div id="cookie-notice">We use cookies on this site to make it better for you and all of our partners.</div>
<div class="layout"><div class="{kind}"><h1>A title&nbsp;here</h1>
<p>The first paragraph of the text is long   enough to stand
 out &amp; is <b>bold</b> and <a href="/x">linked</a>.<p>Short.
<div class="adBox">Buy now, buy everything, buy it all the time, a long advert that looks like any text.</div>
<p>The last paragraph is again rather long, so that the core has two ends, with caf&#233;<br>and a break.</p>
<form><input value=x><button>Send</button>Write to us about this, we are glad about every letter</form></div>
<aside>See also this other page, which is about something else but long enough to matter.</aside>
<section class="comments"><p>I do not agree with this text at all, said the reader, and wrote it here at length.</p></section></div>
<footer>&copy; someone, and a long footer line about the imprint and the terms of use of this site</footer></body></html>"""
WANT = (
    "A title here\nThe first paragraph of the text is long enough to stand out & is bold and linked.\nShort.\n"
    "The last paragraph is again rather long, so that the core has two ends, with café and a break."
)


def test_noise_goes_with_and_without_article_element():
    assert html.main_text(PAGE.replace("{kind}", "post")) == WANT
    as_article = PAGE.replace('<div class="{kind}">', "<article>").replace("</form></div>", "</form></article>")
    assert html.main_text(as_article) == WANT


def test_odd_pages(spark):
    long = "<article>" + "<p>word word word word</p>" * 20_000 + "</article>"
    odd = [None, "", " ", "<p>", "<![foo]>x<p>y", "plain text", "<div>" * 5000 + "deep text here" + "</div>" * 10, "</p></div>a", "<a href=x>only link</a>", long]
    rows = [(k % 8 or None, "u", page, "clash") for k, page in enumerate(odd)] + [(1, "u", "plain text", "x")] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.extracted(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.text.startswith(("plain", "deep"))} == {"plain text", "deep text here"}
    assert max(r.n_chars for r in got) == 20_000 * 20 - 1
    assert html.extracted(df.limit(0)).count() == 0


def test_smoothing_keeps_a_constant():
    assert all(abs(x - 4.0) < 1e-12 for x in html.smoothed([4.0] * 7))


def prose(k, n=30):
    return " ".join(f"word{k}x{j}" for j in range(n)) + "."


MENU = "<nav><a href=/>Home</a></nav><div>Menu</div>"


def test_title_and_lead_outside_the_body_element_stay():
    body = "".join(f"<p>{prose(k)}</p>" for k in range(8))
    want = "\n".join(["Title", "A lead.", *map(prose, range(8))])
    for tag in ("article", "main"):
        assert html.main_text(f"{MENU}<{tag}><h1>Title</h1><p>A lead.</p><div class=body>{body}</div></{tag}><div>Imprint</div>") == want


def test_unequal_sections_stay():
    sections = "".join(f"<section>{''.join(f'<p>{prose(100 * s + k)}</p>' for k in range(n))}</section>" for s, n in enumerate((23, 2)))
    want = "\n".join(prose(100 * s + k) for s, n in enumerate((23, 2)) for k in range(n))
    assert html.main_text(f"<body>{MENU}<div>{sections}</div><footer>Imprint</footer></body>") == want


def test_one_very_long_block_leaves_its_siblings():
    parts = [prose(k) for k in range(12)]
    parts[6] = prose(6, 5000)
    page = f"<body>{MENU}<div>{''.join(f'<div><p>{p}</p></div>' for p in parts)}</div></body>"
    assert html.main_text(page) == "\n".join(parts)


def test_marked_wrappers_of_the_article_stay():
    inner = "<h1>Title</h1>" + "".join(f"<p>{prose(k)}</p>" for k in range(6))
    want = "\n".join(["Title", *map(prose, range(6))])
    side = f"<div class=sidebar><p>{prose(90)}</p></div><section id=comments><article class=comment><p>{prose(91)}</p></article></section>"
    for names in ("content has-sidebar", "no-comments", "comments-open", "layout sidebar-right"):
        for body in (f"<article>{inner}</article>", f"<div class=post>{inner}</div>"):
            assert html.main_text(f"<body>{MENU}<div class='{names}'>{body}{side}</div></body>") == want


def test_a_form_around_the_page_keeps_the_article():
    inner = "".join(f"<p>{prose(k)}</p>" for k in range(6))
    form = "<form action=/send><label>Your name</label><input>Write to us</form>"
    want = "\n".join(["Title", *map(prose, range(6))])
    for body in (f"<article><h1>Title</h1>{inner}{form}</article>", f"<div><h1>Title</h1>{inner}</div>"):
        assert html.main_text(f'<body><form id="aspnetForm">{MENU}{body}<footer>Imprint</footer></form></body>') == want


def test_outputs_and_labels_of_a_paragraph_stay():
    page = f"<article><p>{prose(1)} It is <output>42</output>, says the <label>label</label> here.</p><p>{prose(2)}</p></article>"
    assert html.main_text(page) == f"{prose(1)} It is 42, says the label here.\n{prose(2)}"


def test_sections_of_an_article_named_like_noise_stay():
    parts = [f"<p>{prose(k)}</p>" for k in range(8)]
    page = f"<article>{''.join(parts[:4])}<section id=discussion>{parts[4]}{parts[5]}</section><div id=related-work>{parts[6]}</div>{parts[7]}</article>"
    assert html.main_text(f"<body>{MENU}{page}</body>") == "\n".join(map(prose, range(8)))
    noise = "<div class=related><ul><li><a href=/1>One more</a><li><a href=/2>Another</a></ul></div>"
    comments = f"<section class=discussion><div class=comment><p>{prose(91)}</p></div></section>"
    assert html.main_text(f"<body>{MENU}<article>{''.join(parts)}{noise}{comments}</article></body>") == "\n".join(map(prose, range(8)))


def test_links_of_an_article_stay():
    parts = [f"<p>{prose(k)}</p>" for k in range(4)]
    page = f"<article>{parts[0]}<blockquote><a href=/q>A quoted link</a></blockquote>{''.join(parts[1:])}<h2>References</h2><ol><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ol></article>"
    want = "\n".join([prose(0), "A quoted link", *map(prose, range(1, 4)), "References", "First source", "Second source"])
    assert html.main_text(f"<body>{MENU}{page}</body>") == want


def test_an_advert_longer_than_the_one_article_goes():
    assert html.main_text(f"<body>{MENU}<div class=ad>{prose(1)}</div><article><h1>Short.</h1><p>Text.</article></body>") == "Short.\nText."
