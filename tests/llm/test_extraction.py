"""Page shapes with the exact text they should give, and markup that must not stop a job."""

import random

import pytest

from cladefreq.llm import extraction

A = "The river runs past old stone houses, where people sell bread and fish every morning of the week."
B = "In winter the market moves into the hall behind the church, and the boats stay in the harbour for months."
C = "Nobody remembers when the bridge was built, but all agree that it was there before the mill."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sports</a></li><li><a href=/w>Weather</a></li></ul>"
THREE = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
ALL = f"{A}\n{B}\n{C}"

SHAPES = {
    "article": (f"<body><nav>{MENU}</nav><article>{THREE}</article><footer>Imprint</footer></body>", ALL),
    "title and last line": (f"<article><h1>My title</h1><div class=body>{THREE}</div><p>Last line.</p></article>", f"My title\n{ALL}\nLast line."),
    "two sections": (f"<article><section>{THREE}</section><section><p>Short.</p></section></article>", f"{ALL}\nShort."),
    "header in article": (f"<article><header><h1>Title</h1><p>By me</p></header>{THREE}</article>", f"Title\nBy me\n{ALL}"),
    "footer in article": (f"<article>{THREE}<footer>Share this</footer></article>", ALL),
    "aside in article": (f"<article><p>{A}</p><aside>Read more</aside><p>{B}</p></article>", f"{A}\n{B}"),
    "advert in article": (f"<article><p>{A}</p><div class='ad'>Buy now</div><p>{B}</p></article>", f"{A}\n{B}"),
    "advert slot": (f"<article><p>{A}</p><div id='ad-slot-3'>Buy now</div><p>{B}</p></article>", f"{A}\n{B}"),
    "form in article": (f"<article><p>{A}</p><form><label>Mail</label><input></form><p>{B}</p></article>", f"{A}\n{B}"),
    "comments in article": (f"<article>{THREE}<div class=comments><p>{C}</p><p>{A}</p><p>{A}</p><p>{A}</p><p>{A}</p></div></article>", ALL),
    "comments after article": (f"<article>{THREE}</article><div id=comments><h2>2 comments</h2><p>{A}</p></div>", ALL),
    "comments as articles": (f"<main><article>{THREE}</article><article class=comment><p>Nice!</p></article></main>", ALL),
    "reader comments": (f"<article>{THREE}<section class='reader-comments'><p>Nice!</p></section></article>", ALL),
    "page in a form": (f"<body><form id=aspnet>{THREE}</form></body>", ALL),
    "article in a form": (f"<body><form><nav>{MENU}</nav><article>{THREE}</article></form></body>", ALL),
    "social science": (f"<body><div class='social-science'>{THREE}</div></body>", ALL),
    "header image": (f"<article><div class='header-image'><p>{A}</p></div><p>{B}</p></article>", f"{A}\n{B}"),
    "wrapper named for a sidebar": (f"<body><div class='sidebar right'>{THREE}</div></body>", ALL),
    "main": (f"<body><header>Site</header><main><h1>T</h1>{THREE}</main><footer>x</footer></body>", f"T\n{ALL}"),
    "entities": ("<article><p>a &amp; b &eacute; &#8364; &nbsp; c</p></article>", "a & b é € c"),
    "white space": (f"<article><p>  {A.replace(' ', chr(10) + '  ')} </p></article>", A),
    "inline markup": ("<article><p>a <b>b</b><i>c</i> <a href=x>d</a></p></article>", "a bc d"),
    "line breaks": ("<article><p>one<br>two<br/>three</p></article>", "one two three"),
    "open paragraphs": (f"<article><p>{A}<p>{B}<p>{C}</article>", ALL),
    "open bold": (f"<article><h1>T</h1><p><b>{A}<br><p>{B}</p></article>", f"T\n{A}\n{B}"),
    "lists": ("<article><ul><li>one<li>two</ul><ol><li>three</ol></article>", "one\ntwo\nthree"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    "scripts": (f"<article><script>var a = '<p>x</p>';</script><style>p{{}}</style><noscript>no</noscript><p>{A}</p></article>", A),
    "comment markup": (f"<article><!-- <p>x</p> --><p>{A}</p></article>", A),
    "doctype with declarations": (f"<!DOCTYPE html [<!ELEMENT br EMPTY>]><article><p>{A}</p></article>", A),
    "marked section": (f"<article><p>{A}</p><![foo[x]]><p>{B}</p></article>", f"{A}\n{B}"),
    "cdata": (f"<article><p>{A}</p><![CDATA[x]]></article>", A),
    "no article": (f"<body><div>{MENU}</div><div id=c><h1>Title</h1>{THREE}<p>End.</p></div><div>{MENU}</div></body>", f"Title\n{ALL}\nEnd."),
    "no article, marked parts": (
        f"<body><div class=menu>{MENU}</div><div><div>{THREE}</div></div><div class='cookie-notice'>We use cookies</div></body>", ALL),
    "flat body": (f"<body>{MENU}<h1>Title</h1>{THREE}{MENU}</body>", f"Title\n{ALL}"),
    "title beside the text": (f"<body><div>{MENU}</div><div><h1>Title</h1><div>{THREE}</div><p>End.</p></div></body>", f"Title\n{ALL}\nEnd."),
    "two parts without article": (f"<body><div>{MENU}</div><div><div>{THREE}</div><div><p>Short.</p></div></div></body>", f"{ALL}\nShort."),
    "plain text": (A, A),
    "one line": ("<p>Hi</p>", "Hi"),
    "only a menu": (f"<body><nav>{MENU}</nav></body>", ""),
    "empty": ("", ""),
    "no text": ("<html><body><div></div></body></html>", ""),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shape(name):
    html, text = SHAPES[name]
    assert extraction.content(html) == text


BROKEN = ["<![ <p>", "<!", "<!-", "<!--", "<![", "<![foo", "<![CDATA[", "<?", "<?x", "</", "</>", "<", "<a", "<a b='", "&#", "&#x;", "&#99999999;",
          "<!doctype", "<!DOCTYPE [", "<!ELEMENT", "<![if !IE]>", "<![endif]-->", "<script>", "<textarea>", "\x00", "]]>"]


@pytest.mark.parametrize("broken", BROKEN)
def test_broken_markup_keeps_the_text(broken):
    assert A in extraction.content(f"<article><p>{A}</p></article>{broken}")


def test_random_markup_never_fails():
    draw = random.Random(3)
    parts = [*BROKEN, "<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<form>", "</form>", "text", " ", "<a>", "</a>", "<li>", "<h1>", "<main>", "</b>"]
    for _ in range(3000):
        html = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert isinstance(extraction.content(html), str)


def test_deep_and_long_pages():
    assert extraction.content("<div>" * 5000 + A + "</div>" * 5000) == A
    many = "".join(f"<p>{A} {i}</p>" for i in range(5000))
    assert extraction.content(f"<article>{many}</article>").count("\n") == 4999


def test_rows(spark):
    rows = [(1, "u", SHAPES["article"][0], "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", "<![ <p>", "t"), (3, "v", "<p>Hi</p>", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extraction.extract(frame).collect()), key=str)
    assert got == sorted([(1, "u", ALL, len(ALL)), (2, None, "", 0), (None, "u", "", 0), (1, "u", "", 0), (3, "v", "Hi", 2)], key=str)
    assert extraction.extract(frame.where("false")).count() == 0
