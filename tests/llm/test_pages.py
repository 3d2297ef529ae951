import math
import resource
import time
from html.parser import HTMLParser

from textloom.llm import pages


def page(article, i=0):
    return (
        f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        f'<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy {i}</div>'
        f'<div class="cookie-notice">We use cookies</div>{article}<aside class="sidebar">Side</aside><div id="comments"><article class="comment"><p>Nice!</p></article></div>'
        f"<form><p>Mail me</p><input></form><footer>&copy; me</footer></body></html>"
    )


def test_one_page():
    got = pages.main_text(page("<article><header><h1>Tit&amp;le</h1></header><p><b>One\n two<br>three<p>Four &lt;b&gt; &eacute;\xa0five</p><ul><li>a<li>b</ul><div class='share'>Tweet</div>tail</article>"), set())
    assert got == "Tit&le\nOne two three\nFour <b> é five\na\nb\ntail"
    assert pages.main_text(None, set()) == pages.main_text("", set()) == ""
    assert pages.main_text("<article><p>cut &am", set()) == "cut &am"
    assert pages.main_text("a < b <p class='x>y", set()).startswith("a < b")
    assert pages.main_text("<p>" * 30000 + "deep", set()) == "deep"


def test_style_tree_drops_what_repeats_on_a_host(spark):
    body = "<html><body><div class=top><span>Welcome all</span></div><div class=text><p>Story {i} of one host</p><p>Same line</p></div><div class=bottom>Call now</div></body></html>"
    rows = [(i, f"http://a.example/{i}", body.format(i=i)) for i in range(12)]
    rows += [(50, "http://lone.example/", body.format(i=50)), (51, None, None), (52, "http://a.example/x", ""), (0, "http://a.example/0", body.format(i=0))]
    rows += [(100 + i, f"http://c.example:80/{i}", page("<article><p>Equal text</p></article>", i)) for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as noisy")
    got = pages.extract_pages(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 12:
            assert r.text == f"Story {r.page_id} of one host\nSame line"
        elif r.page_id == 50:
            assert r.text == "Welcome all\nStory 50 of one host\nSame line\nCall now"
        elif r.page_id >= 100:
            assert r.text == "Equal text"
        else:
            assert r.text == ""
        assert r.n_chars == len(r.text)
    assert pages.extract_pages(frame.limit(0)).count() == 0


class PlainTree(HTMLParser):
    """Paths, child tags and texts of a well-formed page, from the definition."""

    def __init__(self, html):
        super().__init__()
        self.path, self.styles, self.texts, self.open = [], [], [], [[]]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        names = "".join("." + c for c in dict(attrs).get("class", "").split())
        self.open[-1].append(tag)
        self.path.append(tag + names)
        self.open.append([])

    def handle_endtag(self, tag):
        self.styles.append(("/" + "/".join(self.path), tuple(self.open.pop())))
        self.path.pop()

    def handle_data(self, data):
        self.texts.append(("/" + "/".join(self.path), " ".join(data.split())))


def plain_importance(htmls):
    """Importance of each path of one host's different pages."""
    styles, texts = {}, {}
    for html in htmls:
        tree = PlainTree(html)
        for path, style in set(tree.styles):
            styles.setdefault(path, []).append(style)
        for path, text in set(tree.texts):
            texts.setdefault(path, []).append(text)
    out = {}
    for path, seen in styles.items():
        m = len(seen)
        if m < pages.LEAST_PAGES:
            continue
        shares = [seen.count(s) / m for s in set(seen)]
        shown = max(0, -sum(p * math.log(p, m) for p in shares))
        found = texts.get(path, [])
        spread = [math.log(found.count(t), m) for t in set(found)]
        own = max(0, 1 - sum(spread) / len(spread)) if spread else 0
        damped = pages.DAMPING ** len(shares)
        out[path] = (1 - damped) * shown + damped * own
    return out


def test_importance_equals_its_definition(spark):
    rows = []
    for k in range(3):
        for i in range(3 + 4 * k):
            body = "".join(f"<p>Text {k} {i} {j}</p>" for j in range(i % 4)) + "<p>Shared</p>"
            html = f"<html><body><nav><ul><li>Home</li><li>Page {i % 2}</li></ul></nav><div class='x one'>Same</div><article>{body}<div class=q>Read more</div></article></body></html>"
            rows.append((len(rows), f"http://h{k}.example/{i}", html))
    rows += rows[3:5] * 3  # copies change nothing
    got = {(r.host, r.node): r.importance for r in pages.importance(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {}
    for k in range(3):
        htmls = {h for _, u, h in rows if u.startswith(f"http://h{k}.")}
        want |= {(f"h{k}.example", pages.node_of(p)): x for p, x in plain_importance(htmls).items()}
    assert got.keys() == want.keys() and len(got) >= 8
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_tree_decides_without_telling_names(spark):
    """Furniture of plain divs and paragraphs, outside and inside articles; the page alone cannot tell it."""
    site = (
        "<html><body><div class=va><div>Start</div><div>Topics</div><div>About</div></div><div class=vb><p>Story {i}, told at length and unlike any other one.</p><p>More of story {i}.</p>"
        "<section class=vc><p>Follow our channel for news</p></section></div><div class=vd>Offices in four towns</div></body></html>"
    )
    held = "<html><body><article><h1>Title {i}</h1><p>Body of story {i}, long enough to be most of it.</p><div class=ve><p>Sign up today</p></div></article></body></html>"
    rows = [(i, f"http://a.example/{i}", site.format(i=i)) for i in range(8)] + [(100 + i, f"http://b.example/{i}", held.format(i=i)) for i in range(8)]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        alone = pages.main_text(rows[i][2], set())
        assert "Start" in alone and "Follow our channel" in alone and "Offices" in alone
        assert got[i] == f"Story {i}, told at length and unlike any other one.\nMore of story {i}."
        assert got[100 + i] == f"Title {i}\nBody of story {i}, long enough to be most of it."


def test_deep_nesting_takes_linear_time_and_memory():
    def took(html):
        began = time.process_time()
        pages.main_text(html, set())
        return time.process_time() - began

    for shape in ("<div class=a>" * 1000 + "deep", "<div>" * 500 + "</section>" * 500, "<span>" + "<div>" * 500 + "</span>" * 500, "<b>" * 500 + "<p>x</p>" * 500, "<svg>" * 900):
        html = shape * 8
        took(html)
        once, often = min(took(html) for _ in range(3)), min(took(html * 8) for _ in range(2))
        assert often < 24 * once + 0.2, shape[:20]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    pages.main_text("<div class=some-name>" * 32000 + "deep", set())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000  # kB


SHOP = "<html><body><div class=line>{head}</div><div class=box><p>{a}</p><p>{b}</p></div><div class=low><p>{legal}</p><div class=inner>{more}</div></div></body></html>"


def plain_texts(rows):
    """Texts of pages whose elements say nothing of what they are: blocks whose branch is unimportant go, by the plain importance of each host."""
    sites = {}
    for _, url, html in rows:
        sites.setdefault(url.split("/")[2], set()).add(html)
    low = {site: {pages.node_of(n) for n, v in plain_importance(sorted(htmls)).items() if v < pages.IMPORTANT} if len(htmls) >= pages.LEAST_PAGES else set() for site, htmls in sites.items()}
    out = {}
    for page_id, url, html in rows:
        blocks, elements = pages.parse(html)
        dead = low[url.split("/")[2]]
        below = {}
        for e in reversed(elements):
            below[id(e)] = below.get(id(e), False) or e.node not in dead
            below[id(e.parent)] = below.get(id(e.parent), False) or below[id(e)]
        out[page_id] = "\n".join(t for t, e in blocks if below[id(e)])
    return out


def test_texts_of_hosts_with_many_pages_rest_on_the_tree(spark):
    """Hosts of 24 pages, one with banners, legal lines and boxes that repeat under names that say nothing; and a host of too few pages."""
    rows = []
    for h in range(3):
        for i in range(24):
            head = "Always the same line" if h < 2 else f"Line {i}"
            rows.append((len(rows), f"http://h{h}.example/{i}", SHOP.format(head=head, a=f"Story {h} {i}", b=f"Told on day {i}", legal="All rights", more="Part of a group" if h else f"Unlike {i}")))
    rows += [(len(rows) + i, f"http://few.example/{i}", SHOP.format(head="Same", a=f"x{i}", b="y", legal="z", more="w")) for i in range(3)]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == plain_texts(rows)
    off = {i: pages.main_text(html, set()) for i, _, html in rows}
    assert sum(got[i] != off[i] for i in got) == 72 and all(got[i] == off[i] for i in range(72, 75))
    assert got[0] == "Story 0 0\nTold on day 0\nUnlike 0" and got[30] == "Story 1 6\nTold on day 6"


def test_reasons_add_up():
    html = "<body><div class=a>Top</div><nav>Menu</nav><article><p>Story told at length</p><div class=b>Repeated</div></article><p>Beside</p></body>"
    low = {pages.node_of(x) for x in ("/body/div.a", "/body/article/div.b", "/body/nav")}
    assert pages.removed_by(html, low) == {"kept": 1, "tree": 3, "scope": 1} and pages.removed_by(html, set()) == {"kept": 2, "name": 1, "scope": 2}
