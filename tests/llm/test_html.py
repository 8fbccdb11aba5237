import random
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">{menu}</a></li><li>Two</li></ul></nav><!-- ad --><div class="ad">{ad}</div>
<div class="cookie-notice"><p>We use cookies</p></div><article><header><h1>{title}</h1></header><p><b>{first}<br>more&nbsp;of &lt;it&gt;<p>Second
  <i>para</i>graph</p>{extra}<form><p>Mail</p><input></form><ul><li>one<li>two</ul><div class="share">Share</div><footer>By me</footer></article>
<aside>Side</aside><section id="comments"><article class="comment"><p>A reader</p></article></section><footer>&copy; x</footer></body></html>"""


def pages(n=12):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    out = []
    for i in range(n):
        v = {k: word() for k in ("menu", "ad", "title", "first")}
        v["extra"] = f"<h2>{word()}</h2><p>x &#233;</p>" if i % 3 == 0 else ""
        out.append((PAGE.format(**v), v))
    return out


def texts_of(spark, rows):
    """The main texts of ``(page_id, url, html)`` rows, by id."""
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.main_texts(df).collect()}


def expected(v):
    extra = [v["extra"][4:10], "x é"] if v["extra"] else []
    return [v["title"], f"{v['first']} more of <it>", "Second paragraph", *extra, "one", "two"]


def test_article_without_what_is_around_it(spark):
    # "Second paragraph", "one" and "two" stand on every page of the host, as running text of the article.
    for n in (3, 12):
        made = pages(n)
        found = texts_of(spark, [(i, "http://a/", p) for i, (p, _) in enumerate(made)])
        assert [found[i].split("\n\n") for i in range(n)] == [expected(v) for _, v in made]


def wrapper(made):
    return html.infer([text for _, text in sorted(html.outlined(p)[:2] for p in made)])


def hosts():
    """Three hosts whose templates put words of their own where no element or class tells them, with and without articles."""
    rows, want = [], {}
    for i in range(30):
        h = i % 3
        body, lead = f"text {i} " + "abc"[i % 3] * (i % 7 + 1), f"lead {i}"
        if h == 0:
            page = f'<article><h1>Same heading</h1><div class="q7 boxed"><p>Join our readers</p></div><p>{lead}</p><p>{body}</p><div class="zz">{["Rain", "Sun"][i % 2]} today</div></article>'
            want[i] = ["Same heading", lead, body]
        elif h == 1:
            page = f'<table><tr><td>Best site ever</td></tr></table><div><p>{lead}</p></div><h4>Always here</h4><section><p>{body}</p></section>'
            want[i] = [lead, body]
        else:
            page = f'<main><div class="related-work"><p>{lead}</p></div><div class="text"><p>{body}</p></div><div class="stamp">Printed on paper</div></main>'
            want[i] = [lead, body]
        rows.append((i, f"http://h{h}.example/{i}", page))
    return rows, want


def test_the_wrapper_decides(spark, monkeypatch):
    rows, want = hosts()
    got = texts_of(spark, rows)
    assert {i: t.split("\n\n") for i, t in got.items()} == want
    # Without a wrapper the template's words stay, on all three hosts.
    monkeypatch.setattr(html, "CONSTANT_PAGES", 1000)
    assert all(texts_of(spark, rows)[i] != got[i] for i in range(30))


def test_dealing_and_copies_change_nothing(spark, monkeypatch):
    rows, want = hosts()
    for n, handed in ((1, 1024), (7, 1), (3, 2)):
        monkeypatch.setattr(html, "HANDED_ON", handed)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        assert {r.page_id: r.text.split("\n\n") for r in html.main_texts(df).collect()} == want
    # A host grows by other pages, or by the same ones: a page's text stays as it is.
    more = [(1000 + i, u, p.replace("text", "other").replace("lead", "start")) for i, u, p in rows for _ in range(3)]
    got = texts_of(spark, rows + more + [(2000 + i, u, p) for i, u, p in rows])
    assert {i: got[i].split("\n\n") for i in want} == want
    # Copies of one page, or too few pages, show nothing of a template.
    assert texts_of(spark, [(i, "http://a/", rows[0][2]) for i in range(50)])[0].split("\n\n") == ["Same heading", "Join our readers", "lead 0", "text 0 a", "Rain today"]


def test_deep_and_long_pages_keep_their_text(spark):
    deep = lambda n: "<div>" * n + "<article><p>main text</p></article>" + "</div>" * n
    long = "<article>" + "".join(f"<h2>h {i}</h2><p>p {i}</p>" for i in range(20_000)) + "</article>"
    turned = "<article>" + "".join(f"<p>{i % 250}</p><h3>x</h3>" for i in range(1, 251)) + "</article>"
    got = texts_of(spark, [(0, "u", deep(200)), (1, "u", deep(5000)), (2, "u", "<ul><li>" * 3000 + "in"), (3, "v", long), (4, "w", turned), (5, "x", "</b></p>" * 20_000 + "<i>" * 20_000 + "end"), (6, "y", '<article class="post sharing-economy"><p>kept</p></article>')])
    assert got[0] == got[1] == "main text" and got[2] == "in" and got[5] == "end" and got[6] == "kept"
    assert got[3].split("\n\n") == [f"{k} {i}" for i in range(20_000) for k in "hp"] and len(got[4].split("\n\n")) == 500


class Reader(HTMLParser):
    """A plain reading of the test pages: the blocks of the article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.inside = [[]], False

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in ("p", "h1", "h2", "ul", "li", "div"):
            self.out.append([])
        elif tag == "br":
            self.out[-1].append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1", "h2", "ul", "li", "div"):
            self.out.append([])

    def handle_data(self, data):
        if self.inside:
            self.out[-1].append(data)


def test_driver_pages_against_a_plain_reading(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    for r in df.collect():
        reader = Reader()
        reader.feed(r.html)
        blocks = [" ".join("".join(b).split()) for b in reader.out]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_wrapper_is_a_union_free_expression():
    shown = html.expression(wrapper([p for p, _ in pages()]))
    assert "(<h2>#PCDATA</>)?" in shown and "(<li>#PCDATA</>)+" in shown and "|" not in shown


def test_query_with_awkward_rows(spark, monkeypatch):
    rows = [(i, f"http://hot.example/{i}", p) for i, (p, _) in enumerate(pages(23))]
    rows += [(100, None, None), (101, "http://b/", ""), (None, "x", "just words"), (102, "HTTP://U@B:80/q", "<p>a<p>b</p></div><div>c"), (103, "ftp://c", "<" * 50), rows[0], ((1 << 62) + 1, "http://d", "<div>" * 500 + "deep" + "</div>" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "outline", "wrapper", "n", "content", "text", "blocks"):
        df = df.withColumn(name, html.F.lit("own"))
    for sent in (html.SENT_BYTES, -1):
        monkeypatch.setattr(html, "SENT_BYTES", sent)
        got = {(r.page_id, r.url): r.text for r in html.main_texts(df).collect()}
        assert len(got) == len(rows) - 1 and html.main_texts(df).count() == len(rows)
        assert got[100, None] == "" and got[101, "http://b/"] == "" and got[None, "x"] == "just words" and got[102, "HTTP://U@B:80/q"] == "a\n\nb\n\nc"
        assert got[(1 << 62) + 1, "http://d"] == "deep" and got[0, "http://hot.example/0"].startswith(pages(1)[0][1]["title"])
    assert html.main_texts(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="<>/!-\"' pdivscriptab=&;"), max_size=4))
def test_any_markup_ends(made):
    html.expression(wrapper(made))
    for page in made:
        html.main_text(page, html.unpacked(html.packed(wrapper(made))))


#: Pages whose text is told without a wrapper, in any number on a host; ``%d`` is the page's number.
TOLD = {
    '<article><h1>Title %d</h1><p>The same wire report body.</p></article>': "Title %d\n\nThe same wire report body.",
    '<article><h1>Title %d</h1><div class="story"><p>The same wire report body.</p></div></article>': "Title %d\n\nThe same wire report body.",
    '<h1>Title %d</h1><div><p>The same wire report body.</p></div>': "Title %d\n\nThe same wire report body.",
    '<div class="related"><article><p>Teaser %d</p></article></div><article><p>Main %d</p></article>': "Main %d",
    '<div class="related"><article><p>Teaser %d</p></article></div><div><p>Main %d</p></div>': "Main %d",
    '<article><p>Main %d</p><section class="related-posts"><article class="card"><p>Teaser</p></article></section></article>': "Main %d",
    '<div class="sidebar"><article>Side %d</article></div><article>Main %d</article>': "Main %d",
    '<article><p class="ad">Buy now</p><p>Main %d</p></article>': "Main %d",
    '<article><p>Main %d</p><p class="notice">We use cookies %d</p></article>': "Main %d",
    '<article><ul class="nav"><li>Home</li><li>News</li></ul><p>Main %d</p></article>': "Main %d",
    '<article><p>Main %d</p><ul class="comments"><li>Nice %d</li></ul></article>': "Main %d",
    '<article><p>Main %d</p><ol class="comment-list"><li>Nice</li></ol></article>': "Main %d",
    '<article><p>Main %d</p><ul class="features"><li>Fast</li></ul><table class="header"><tr><td>Year<td>Sum</table></article>': "Main %d\n\nFast\n\nYear\n\nSum",
}


def test_nothing_is_lost_and_nothing_stays_at_any_size_of_a_host(spark):
    rows, want = [], {}
    for k, (page, text) in enumerate(TOLD.items()):
        for n in (1, 3, 4, 300):
            for i in range(n):
                want[len(rows)] = text.replace("%d", str(i))
                rows.append((len(rows), f"http://h{k}-{n}/{i}", page.replace("%d", str(i))))
    assert texts_of(spark, rows) == want


def template_pages(seed, n=24):
    """Pages of a random template, and their texts without the template's own: ``n`` of them, each part with a sign of its own or shared ones."""
    r = random.Random(seed)
    parts = []
    for k in range(r.randint(2, 5)):
        kind = r.choice(["own", "own in a list", "slot", "optional own", "optional", "repeated", "group"])
        parts.append((kind, r.choice(["div", "section", f"div class=k{'abcdef'[k]}"])))
    parts.insert(r.randint(0, len(parts)), ("body", "div class=body"))
    out = []
    for i in range(n):
        page, kept = "", []
        for k, (kind, tag) in enumerate(parts):
            name = tag.split()[0]
            here = f"{i} {k} said on this page alone " + "and more " * r.randint(0, 9)
            if kind == "own":
                page += f"<{tag} id=x{k}><p>Template {k}</p></{name}>"
            elif kind == "own in a list":
                page += f"<{tag}><ul><li>Home {k}</li><li>News {k}</li></ul></{name}>"
            elif kind == "optional own":
                page += f"<{tag}><h6>Seldom {k}</h6></{name}>" if r.random() < 0.8 else ""
            elif kind == "optional":
                if r.random() < 0.5:
                    page += f"<{tag}><h5>{here}</h5></{name}>"
                    kept.append(here.strip())
            else:
                many = {"slot": 1, "body": 3}.get(kind, r.randint(1, 4))
                for j in range(many):
                    page += f"<{tag}><p>{here}{j}</p></{name}>" + (f"<h4>{here}{j} ends</h4>" if kind == "group" else "")
                    kept += [f"{here}{j}", *([f"{here}{j} ends"] if kind == "group" else [])]
        out.append((page, [" ".join(x.split()) for x in kept]))
    return parts, out


def runs_apart(parts):
    """Whether the template tells its own parts from others: no neighbour could be taken for one more of the same."""
    signs = [(tag, {"own in a list": "ul", "optional own": "h6", "optional": "h5"}.get(kind, "p")) for kind, tag in parts]
    return len({tag for _, tag in parts}) == len(parts) and len(set(signs)) == len(signs)


def test_wrappers_of_random_templates_leave_out_what_the_template_says():
    seen = 0
    for seed in range(400):
        parts, made = template_pages(seed)
        if not runs_apart(parts):
            continue
        seen += any("own" in kind for kind, _ in parts)
        packed = html.packed(wrapper([p for p, _ in made][: html.SAMPLE]))
        for page, kept in made:
            assert [x for x in html.main_text(page, html.unpacked(packed)).split("\n\n") if x] == kept, (parts, html.expression(html.unpacked(packed)))
    assert seen > 40


def test_order_tells_equal_elements_apart():
    page = "<div>Always this</div><p>{0} a text that is long enough</p><h2>{0}</h2><div>{0} varies</div>"
    made = [page.format(i) + "<p>and {0}</p>".format(i) * (i % 3) for i in range(16)]
    packed = html.packed(wrapper(made))
    assert html.main_text(made[4], html.unpacked(packed)).split("\n\n") == ["4 a text that is long enough", "4", "4 varies", "and 4"]


def test_repeated_groups_and_optional_terms():
    made = [f"<main>{'<div class=q><b>Rule</b></div>' if i % 4 else ''}" + "".join(f"<h3>t {i} {j}</h3><div>d {i} {j} words</div>" for j in range(i % 3 + 1)) + "</main>" for i in range(16)]
    found = wrapper(made)
    shown = html.expression(found)
    assert "(<div.q>#OWN</>)?" in shown and "(<h3>#PCDATA</> <div>#PCDATA</>)+" in shown
    assert html.main_text(made[5], html.unpacked(html.packed(found))).split("\n\n")[0] == "t 5 0"
    assert html.main_text(made[5], None).split("\n\n")[0] == "Rule"


def test_a_template_never_outweighs_what_differs():
    body = "<div class=intro><p>A report that all pages of the host carry, word for word.</p></div>"
    made = [f"<article><h1>Title {i}</h1><p>By {i}</p>{body}</article>" for i in range(20)]
    assert "report" in html.main_text(made[0], html.unpacked(html.packed(wrapper(made[:16]))))


def test_all_pages_of_a_host_have_a_say(spark):
    """The sixteen pages with the smallest hashes carry the same words where all others have their own."""
    page = "<main><div class=box><b>{0}</b></div><div class=text><i>a text of page {1} that is long enough</i></div></main>"
    hashed = lambda p: html.outlined(p)[0]
    same = sorted((page.format("Same words", i) for i in range(300)), key=hashed)[:16]
    own = [p for p in (page.format(f"Words {i}", i) for i in range(300, 500)) if hashed(p) > hashed(same[-1])][:100]
    found = texts_of(spark, [(i, "http://a/", p) for i, p in enumerate(same + own)])
    assert len(found) == 116 and all(found[i].startswith("Same words\n\n") for i in range(16)) and all(found[i].startswith("Words ") for i in range(16, 116))
