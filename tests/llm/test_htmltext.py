"""Main texts: hand-written pages, recurring subtrees counted by a plain tree walk, and markup that is broken."""

import random
import xml.etree.ElementTree as ET
from collections import defaultdict

from saleslens.llm import htmltext
from saleslens.llm.htmltext import main_text

SCHEMA = "page_id long, url string, html string, Text string"


def rows_of(spark, pages, **options):
    df = spark.createDataFrame([(i, u, h, "old") for i, (u, h) in enumerate(pages)], SCHEMA)
    got = htmltext.extract(df, **options)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    rows = sorted(got.collect(), key=lambda r: r.page_id)
    assert all(r.n_chars == len(r.text) for r in rows)
    return [r.text for r in rows]


def test_named_parts_go():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var a = "</p><article>no</article>";</script></head>
    <body class="has-sidebar"><header class="site"><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div id="cookie-notice">We use cookies</div><!-- <p>gone</p> -->
    <div class="content-with-sidebar"><main><article><header><h1>Head&nbsp;line</h1><p>By me</p></header><p>One<br>two &lt;b&gt; &eacute; &#x41;&#66 <b>bold
    text<p>Next <i>par</i>agraph<script>x()</script> ends<ul><li>first<li>second</ul><form><p>Mail</p></form><div class="adBanner">Buy</div>
    <blockquote>Quo<span>ted</span></blockquote><table><tr><td>a<td>b<tr><th>c</table><div hidden>no</div><p style="display: none">no</p>
    <aside><p>side</p></aside><section id="comments"><article><p>I disagree at great length, of course I do, over and over again</p></article></section></article></main>
    <aside>more</aside></div><footer>F</footer>"""
    assert main_text(page) == "Head line\nOne two <b> é AB bold text\nNext paragraph ends\nfirst\nsecond\nQuoted\na\nb\nc"
    assert main_text("<div class='comments'>c</div><main role=main>a<div>b</div>c</main>") == "a\nb\nc"
    assert main_text("<p>no article</p>tail <b>bold</b><footer>f</footer>") == "no article\ntail bold"
    assert main_text("<article>short</article><article>the longer one</article>") == "the longer one"
    assert main_text("<article><p>a < b & c &amp &am</p><p>cut <a href='x") == "a < b & c & &am\ncut"
    for empty in ("", " ", "<", "</", "<!", "<!--", "<script>", "<p>", "</p></div>", "<nav>a</nav>"):
        assert main_text(empty) in ("", "<")


def site(host, n, article="<div class='x'><h2>{0} head</h2><p>text {0}</p><p>All rights reserved.</p></div>"):
    return [(f"https://{host}/{i}", f"<html><body><div><span>Home</span><div>News</div></div>{article.format(i)}<div><p>Imprint of {host}</p><p>Legal</p></div></body></html>") for i in range(n)]


def test_templates_go_where_they_recur(spark):
    many, few = site("Many.example", 30), site("few.example", 3)
    got = rows_of(spark, many + few + [(None, many[0][1]), ("nonsense", few[0][1]), ("https://x/", None), ("https://x/", "")])
    assert got[:30] == [f"{i} head\ntext {i}" for i in range(30)]  # a body without article: lines that recur are the site's
    assert got[30:33] == [f"Home\nNews\n{i} head\ntext {i}\nAll rights reserved.\nImprint of few.example\nLegal" for i in range(3)]
    assert got[33].startswith("Home") and got[34].startswith("Home") and got[35:] == ["", ""]


def test_lines_of_articles_stay(spark):
    article = "<article><h1>{0}</h1><p>All rights reserved.</p><div><div>Share</div><div>Print</div></div><p>text {0}</p></article>"
    assert rows_of(spark, site("a.example", 20, article)) == [f"{i}\nAll rights reserved.\ntext {i}" for i in range(20)]


def test_copies_are_no_templates(spark):
    """One article on many pages, whole pages repeated, and articles that differ in one word."""
    copies = site("c.example", 40, "<article><div><p>same</p><p>text</p></div></article>")
    assert rows_of(spark, copies) == ["same\ntext"] * 40
    body = "<html><body><div><div><p>same</p><p>page</p></div></div></body></html>"
    assert rows_of(spark, [(f"https://d.example/{i}", body) for i in range(40)]) == ["same\npage"] * 40
    near = site("n.example", 40, "<article><p>same start</p><p>word {0}</p><p>same end</p></article>")
    assert rows_of(spark, near) == [f"same start\nword {i}\nsame end" for i in range(40)]


def plain_templates(pages, min_pages, min_share):
    """Texts below elements and their parents, counted as they are."""
    seen, sizes = defaultdict(set), defaultdict(set)

    def shown(e):
        inner = "|".join(filter(None, [" ".join((e.text or "").split()), *(x for c in e for x in (shown(c), " ".join((c.tail or "").split())))]))
        return f"<{e.tag}>{inner}</>" if inner else ""

    for url, page in pages:
        host = url.split("/")[2]
        sizes[host].add(page)
        stack = [(ET.fromstring(page), "page")]
        while stack:
            e, up = stack.pop()
            if shown(e) and e.tag in htmltext.BLOCKS and e.tag not in ("html", "body"):
                seen[host, shown(e)].add(up)
            stack += [(c, shown(e)) for c in e]
    return sorted((h, len([1 for (g, _), ups in seen.items() if g == h and len(ups) >= max(min_pages, min_share * len(sizes[h]))])) for h in sizes)


def test_counts_against_plain_walk(spark):
    pick = random.Random(5)
    pages = []
    for i in range(120):
        host = pick.choice(["a.example", "a.example", "b.example", "c.example"])
        inner = "".join(f"<{t}>{pick.choice(['x', 'y', str(i)])}<p>{pick.choice(['k', 'l', str(pick.random())])}</p></{t}>" for t in pick.choices(["div", "ul", "span", "section"], k=6))
        pages.append((f"http://{host}/{i}", f"<html><body>{inner}</body></html>"))
    pages += pages[:20]
    df = spark.createDataFrame([(i, u, h, "") for i, (u, h) in enumerate(pages)], SCHEMA)
    for min_pages, share in ((5, 0.0), (3, 0.2)):
        got = {r.host: len(r.templates) for r in htmltext.site_templates(df, min_pages=min_pages, min_share=share).collect()}
        assert sorted((h, got.get(h, 0)) for h, _ in plain_templates(pages, min_pages, share)) == plain_templates(pages, min_pages, share)


def test_any_markup_is_read(spark):
    pick = random.Random(2)
    bits = ["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<b>", "</b>", "<table>", "<tr>", "<td>", "</table>", "<script>", "</script>", "<!--", "-->", "<li>", "<ul>", "</ul>", "&amp;", "&#0;",
            "&#xD800;", "<a href=\"", "'", ">", "<", "text ", "é😀", "<h1>", "</h1>", "<select>", "<option>", "<template>", "</template>", "\x00", "<nav>", "</nav>", "<textarea>"]
    pages = ["".join(pick.choices(bits, k=pick.randrange(60))) for _ in range(1500)]
    for page in pages:
        assert "\n\n" not in main_text(page)
        htmltext.subtrees(page)
    assert len(rows_of(spark, [(f"https://z.example/{i % 3}", h.replace("\x00", "")) for i, h in enumerate(pages)])) == len(pages)
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert main_text(deep) == "text" and len(htmltext.subtrees(deep)) == 20_000
    assert htmltext.extract(spark.createDataFrame([], SCHEMA)).count() == 0
