"""Main text of pages: hand-written layouts, template text of a host, the test pages against their articles."""

import re
from html import unescape

from ledgerline.llm import html_extract as H

SF = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- ad --><div class='ad box'>Buy <b>now</b></div>
<article class="post"><h1>The  &amp;&nbsp;title</h1><p>One <b>bold</b> word<br>next.<p>Two &lt;b&gt;
<script>var t="</p><p>no";</script><ul><li>first<li>second</ul>
<form><label>Name</label><input name="x"><button>Send</button></form>
<section id="comments"><article class="comment"><p>Reader says</p></article></section>
<aside>Related</aside><p>Last</article><div class="sidebar"><p>Side</p></div><footer>&copy; me</footer></body></html>"""


def test_layout():
    assert H.slots(PAGE) == "The & title\nOne bold word next.\nTwo <b>\nfirst\nsecond\nLast"


def test_broken_pages():
    assert H.slots(None) == H.slots("") == H.slots("<!-- open") == ""
    assert H.slots("plain &eacute; text") == "plain é text"
    assert H.slots("<p>a<p>b</i></div><b>c") == "a\nb\nc"
    assert H.slots("<div>x < y & z</div><nav>menu") == "x < y & z"
    assert H.slots("<body><main><p>in</main><p>out") == "in"
    assert H.slots("<p>" + "word " * 100_000) == ("word " * 100_000).strip()


def test_names():
    assert H.slots('<div class="layout has-sidebar"><p title="a hidden gem">in</p><p hidden>out</p></div>') == "in"
    assert H.slots('<p>in<div id="commentList">x</div><div class="siteHeader">x</div><ul class=topMenu><li>x</ul>') == "in"
    assert H.slots('<div class="content"><span aria-hidden="true">in</span> and in</div>') == "in and in"
    assert H.slots('<article class="post"><header><h1>Head</h1></header><p>in</p></article><section class="reader-comments">'
                   '<article><p>x</p></article></section>') == "Head\nin"


def test_template_text(spark):
    rows = [(i, f"http://H.example/{i}", f"<body><div><p>Share this page</p><p>text {i} here</p><p>{'odd' if i % 2 else 'even'}</p></div>")
            for i in range(30)]
    rows += [(100 + i, f"http://small.example/{i}", "<body><p>same article</p>") for i in range(5)]
    rows += [(None, None, None), (200, "no url", "<p>x</p>"), (200, "no url", "<p>x</p>"), (201, "http://e/", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.extract(df).collect()}
    assert H.extract(df).count() == len(rows)
    assert got[(3, "http://H.example/3")] == ("text 3 here\nodd", 15)
    assert got[(101, "http://small.example/1")][0] == "same article"
    assert got[(None, None)] == ("", 0) and got[(200, "no url")] == ("x", 1) and got[(201, "http://e/")] == ("", 0)
    t = H.templates(df).collect()
    assert {r.host for r in t} == {"h.example"}
    assert ">body>div>p" in {r.path for r in t} and any(r.path is None for r in t)
    assert H.extract(df.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        want = [" ".join(unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in want if x)


def test_copies_and_articles(spark):
    """Copies of a page on a host (or without a url), and passages that all articles of a host share."""
    copy = "<body><div><h1>Same head</h1><p>same text</p></div></body>"
    rows = [(i, f"http://copies.example/{i}", copy) for i in range(39)] + [(39, "http://copies.example/39", "<p>other</p>")]
    rows += [(40, "http://copies.example/1", copy)] * 2
    rows += [(100 + i, None, copy) for i in range(20)]
    rows += [(200 + i, f"http://news.example/{i}", f"<body><div>Bar</div><article><h2>Summary</h2><p>text {i}</p><p>The same end</p>"
                                                   "</article></body>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [(r.page_id, r.text) for r in H.extract(df).collect()]
    assert len(got) == len(rows)
    for i, text in got:
        assert text == ("other" if i == 39 else f"Summary\ntext {i - 200}\nThe same end" if i >= 200 else "Same head\nsame text")
    t = {r.token: r.host_pages for r in H.templates(df).where("host = 'news.example'").collect()}
    assert t and set(t.values()) == {30}
    assert H.templates(df).where("host <> 'news.example'").count() == 0


def test_names_inside_articles():
    assert H.slots('<body><article class="promo-story"><p>in</p><section class="related-work"><p>work</p></section>'
                   '<div class="notice">note</div><div class="share-bar">x</div><div id="commentList">x</div></article>'
                   '<div class="related">x</div></body>') == "in\nwork"
    assert H.slots('<body><article class="search-widget"><p>in</p></article><article class="comment"><p>x</p></article></body>') == "in"
    assert H.slots('<main><article class="promo"><p>in</p></article><div class="related">x</div></main>') == "in"
    assert H.slots('<article class="notice"><h1>in</h1><div class="sidebar">SIDE</div><div class="cookie-notice">COOKIE</div>'
                   '<ul class="menu"><li>MENU</ul><div class="promo">PROMO</div><div class="subscribe-box">x</div><p>end</p>'
                   '<article class="promo"><p>x</p></article></article>') == "in\nend"


def slow_templates(rows):
    """Occurrence vectors as whole lists over the distinct pages of a host, classes as equal lists, nesting by parents."""
    hosts = {}
    for _, url, html in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", url or "")
        hosts.setdefault(m.group(1).lower() if m else "", set()).add(html or "")
    out = set()
    for h, contents in hosts.items():
        contents = sorted(contents)
        vectors = {("", None): [1] * len(contents)}
        for i, html in enumerate(contents):
            paths, blocks, has_main = H.parse(html)
            for k in [(p, None) for p in paths] + [(p, t) for p, t, outside, _ in blocks if not outside and not has_main]:
                vectors.setdefault(k, [0] * len(contents))[i] += 1
        known = {k: v for k, v in vectors.items()
                 if sum(x > 0 for x in v) >= max(H.MIN_PAGES, H.SUPPORT * len(contents))}
        size = {}
        for (p, t), v in known.items():
            size[tuple(v)] = size.get(tuple(v), 0) + (2 if t is None else 1)
        valid = {k: v for k, v in known.items() if size[tuple(v)] >= 2}

        def hangs(p, t):
            if (p, t) not in valid:
                return False
            return True if (p, t) == ("", None) else hangs(p, None) if t is not None else hangs(p.rpartition(">")[0], None)

        for (p, t), v in valid.items():
            if hangs(p, t):
                out.add((h, H._hash(p) if t is None else H.text_token(p, t), sum(x > 0 for x in v), sum(v), size[tuple(v)],
                         p.count(">") + (t is not None)))
    return out


def test_classes_against_brute_force(spark):
    rows = []
    for i in range(40):
        bar = "<div class='bar'><p>Home of the bar</p></div>" if i % 4 else ""
        wrap = f"<section id='s{i}'><p>Always here</p></section>"
        rows.append((i, f"http://a.example/{i}", f"<body><div class='top'><h2>Top</h2><p>Since {1990 + i % 2}</p></div>{bar}{wrap}"
                                                 f"<div class='text'>{'<p>more</p>' * (i % 3)}<p>text {i}</p><p>End</p></div></body>"))
        rows.append((100 + i, f"http://b.example/{i}", f"<body><div><p>Bar</p></div><article><p>text {i}</p></article></body>"))
    rows += rows[:5] + [(300, None, None), (301, "x", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r.host, r.token, r.pages, r.uses, r.class_size, r.depth) for r in H.templates(df).collect()}
    want = slow_templates(rows)
    assert got == want and len(got) > 10
    texts = {r.page_id: r.text for r in H.extract(df).collect()}
    # a text that stands everywhere, but each time in another element, hangs below no template element
    assert texts[1] == "Since 1991\nHome of the bar\nAlways here\nmore\ntext 1"
    assert texts[101] == "text 1"


def test_page_classes_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    got = {(r.host, r.token, r.pages, r.uses, r.class_size, r.depth) for r in H.templates(pages, 10).collect()}
    assert got == slow_templates([tuple(r) for r in pages.collect()])


def region_rows():
    """Hosts whose article elements hold template text, a part of the slots, or the article; with the text of each page."""
    rows, want = [], {}

    def add(name, html, text, n=30):
        for i in range(n):
            key = len(rows)
            rows.append((key, f"http://{name}.example/{i}", html(i)))
            want[key] = text(i)

    teaser = "<article class='teaser'><p>Welcome to us</p><p>Join</p></article>"
    # the article element stands there with the same text on every page: it is template
    add("teaser", lambda i: f"<body><nav>menu</nav><div>Bar</div>{teaser}<div class='story'><p>{'text ' * 9}{i}</p><p>more {i % 3}</p></div></body>",
        lambda i: f"{'text ' * 9}{i}\nmore {i % 3}")
    # beside one that holds the article; its shared passages stay
    add("both", lambda i: f"<body>{teaser}<div>Bar {i % 2}</div><article class='post'><h2>Summary</h2><p>{'text ' * 9}{i}</p><p>Same end</p>"
                          "</article></body>", lambda i: f"Summary\n{'text ' * 9}{i}\nSame end")
    # every article under a name of its own is a slot
    add("own", lambda i: f"<body><div>Bar {i % 2}</div><article id='post-{i}'><p>{'text ' * 9}{i}</p></article></body>",
        lambda i: f"{'text ' * 9}{i}")
    # articles that hold less than the slots beside them are not the article
    add("part", lambda i: f"<body><div>Bar</div><article><p>Box {i}</p><p>Same end</p></article><div><p>{'text ' * 9}{i}</p></div></body>",
        lambda i: f"Box {i}\nSame end\n{'text ' * 9}{i}")
    # some pages have only the teaser
    add("mixed", lambda i: f"<body><div>Bar</div>{teaser}<{'article' if i % 3 else 'section'}><p>{'text ' * 9}{i}</p></body>",
        lambda i: f"{'text ' * 9}{i}")
    # one article on different pages stays: nothing else varies, or less text than it holds
    add("one", lambda i: f"<body><nav>menu {i}</nav><article><p>same</p></article></body>", lambda i: "same")
    add("near", lambda i: f"<body><div>at {i}</div><article><h1>same</h1><p>same text</p></article></body>", lambda i: "same\nsame text")
    add("empty", lambda i: f"<body><article></article><div><p>text {i}</p></div></body>", lambda i: f"text {i}")
    # too few pages for classes: the elements decide
    add("few", lambda i: f"<body>{teaser}<div><p>text {i}</p></div></body>", lambda i: "Welcome to us\nJoin", 9)
    return rows, want


def slow_regions(rows):
    """Per host the texts to drop and whether all slots are the region, from whole vectors and lists of slots."""
    hosts = {}
    for _, url, html in rows:
        hosts.setdefault(re.match(r"[a-z]+://([^/]*)", url).group(1), set()).add(html)
    out = {}
    for h, contents in hosts.items():
        parsed = [H.parse(html) for html in sorted(contents)]
        vectors = {"": [1] * len(parsed)}
        for i, (paths, blocks, _) in enumerate(parsed):
            for k in paths + [(p, t) for p, t, outside, _ in blocks if not outside]:
                vectors.setdefault(k, [0] * len(parsed))[i] += 1
        known = {k: v for k, v in vectors.items() if sum(x > 0 for x in v) >= max(H.MIN_PAGES, H.SUPPORT * len(parsed))}
        valid = {k for k, v in known.items() if sum(2 if isinstance(x, str) else 1 for x, w in known.items() if w == v) >= 2}
        same = {k for k in valid if not isinstance(k, str) and max(known[k]) == 1
                and all(">".join(k[0].split(">")[:n]) in valid for n in range(1, k[0].count(">") + 2))}
        slots = [(main, t) for _, blocks, _ in parsed for p, t, outside, main in blocks if not outside and (p, t) not in same]
        alive = {main for main, _ in slots}
        size = {}
        for _, blocks, _ in parsed:
            for _, t, outside, main in blocks:
                size[main] = size.get(main, 0) + len(t) * (main != "" and not outside)
        vacant = {main for main in size if main and main not in alive and sum(len(t) for _, t in slots) > size[main]}
        whole = sum(len(t) for main, t in slots if not main) > sum(n for main, n in size.items() if main not in vacant)
        mains = {(p, t): main for _, blocks, _ in parsed for p, t, _, main in blocks}
        drop = {H.text_token(*k) for k in same if not mains[k] or mains[k] in vacant}
        if valid and (drop or whole):
            out[h] = (drop, whole)
    return out


def test_regions(spark):
    rows, want = region_rows()
    df = spark.createDataFrame(rows + rows[::4], "page_id bigint, url string, html string")
    found = H.stored(H.templates(df, all_texts=True))
    got = {r.host: (set(r.fixed or ()), r.whole_page) for r in H.regions(found).collect()}
    assert got == slow_regions(rows)
    assert {h for h, (_, whole) in got.items() if whole} == {"teaser.example", "part.example", "empty.example"}
    texts = [(r.page_id, r.text) for r in H.extract(df).collect()]
    assert len(texts) == len(rows + rows[::4])
    for i, text in texts:
        assert text == want[i], (rows[i], text)


def test_pages_with_other_elements(spark):
    """The test pages, their articles in other elements and a fixed text in an article element: classes still find the article."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    # hosts with fewer pages have no classes
    count = {}
    for _, url, html in rows:
        count.setdefault(url.split("/")[2], set()).add(html)
    rows = [r for r in rows if len(count[r[1].split("/")[2]]) >= H.MIN_PAGES]
    assert len(rows) > 20
    want = {r[0]: H.slots(r[2]) for r in rows}
    other = [(i, url, html.replace("<article>", "<article><p>Welcome to us</p></article><div class='c7'>").replace("</article><footer", "</div><footer"))
             for i, url, html in rows]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(other, pages.schema)).collect()}
    assert got == want
    assert H.slots(other[0][2]) == "Welcome to us"
