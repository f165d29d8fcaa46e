"""Main text of web pages by removing site templates.

Each page is parsed into its element subtrees, and each subtree with text is hashed (names of elements and text, bottom up).  Spark counts, for every
host and hash, under how many different parents the subtree stands: a menu that recurs on many pages stands under as many different bodies, while parts of an
article that is published many times stand under one and the same parent.  Subtrees that recur on many pages of their host are deleted when
pages are parsed again; what is known by name (menus, forms, scripts, adverts, comments ...) is deleted on any page, so hosts with
few pages are treated too.  The text is that of the page's article (the longest if there are several; without one, of ``main``; without that, of the whole body), all blocks of it.

Inside an article only recurring subtrees made of several blocks go: a single paragraph that recurs is text.

Defined cases: null and empty pages have an empty text; a page without host (null or unusual URL) has no site, so only names count; repeated rows
come out alike and count as one page; broken markup is read as browsers read it, as far as blocks are concerned (paragraphs end where the next
block begins, open elements end with the page); an empty table gives an empty result; columns named like the outputs are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_clashing, materialize
from .urlfilter import host_of

#: A subtree recurs if it stands under so many different parents on a host, and on so large a share of the host's different pages.
MIN_PAGES, MIN_SHARE = 5, 0.005

# Names of HTML elements, ARIA roles, and words in class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
                   "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
OPAQUE = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
DROPPED = OPAQUE | frozenset("aside audio button canvas datalist dialog footer form head menu nav object search select svg template video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar "
                          "navigation newsletter notice notices overlay pager pagination popup promo related reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription "
                          "toolbar topbar widget widgets".split())
WHOLE = frozenset(("html", "body", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements a start tag ends, and which elements hide those outside them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
        "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPES = {"li": frozenset(("ul", "ol", "menu", "table")), "dt": frozenset(("dl", "table")), "dd": frozenset(("dl", "table")), "option": frozenset(("select", "datalist"))}
TABLE = frozenset(("table", "template"))

_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[/!?][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in OPAQUE}


@dataclass
class Page:
    """Elements in page order (the first stands for the page), and the texts between tags as (element, block, text)."""

    names: list[str]
    parents: list[int]
    dropped: list[bool]
    main: list[bool]
    runs: list[tuple[int, int, str]]


def _judged(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element goes by its name and attributes, and whether they mark the main text."""
    drop, main = name in DROPPED, name == "main"
    if attributes and not attributes.isspace():
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html.unescape("".join(values))
            if key in ("class", "id"):
                drop = drop or name not in WHOLE and not DROPPED_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(value))
            elif key == "role":
                drop, main = drop or value.lower() in DROPPED_ROLES, main or value.lower() == "main"
            elif key == "itemprop":
                main = main or value == "articleBody"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                drop = True
    return drop, main


def parse(page: str) -> Page:
    names, parents, dropped, main = ["#page"], [-1], [False], [False]
    runs: list[tuple[int, int, str]] = []
    stack, counts = [0], {}
    block = at = 0

    def close(depth: int) -> None:
        for i in stack[depth:]:
            counts[names[i]] -= 1
        del stack[depth:]

    def find(wanted: Container[str], scope: Container[str]) -> int:
        """Depth of the innermost open element of these names, -1 if the scope's end comes first."""
        for depth in range(len(stack) - 1, 0, -1):
            name = names[stack[depth]]
            if name in wanted:
                return depth
            if name in scope:
                return -1
        return -1

    while at < len(page):
        m = _MARKUP.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            runs.append((stack[-1], block, text))
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            block += 1
        if m.group(1) or m.group(4):
            if counts.get(name):
                depth = find((name,), TABLE if name != "table" else () if name in BLOCKS else BLOCKS)
                if depth > 0:
                    close(depth)
            continue
        if name in BLOCKS and counts.get("p"):
            depth = find(("p",), ("button", "object", "td", "th", "caption", *TABLE))
            if depth > 0:
                close(depth)
        if name in ENDS and any(counts.get(x) for x in ENDS[name]):
            while (depth := find(ENDS[name], SCOPES.get(name, TABLE))) > 0:
                close(depth)
        if name in HEADINGS and names[stack[-1]] in HEADINGS:
            close(len(stack) - 1)
        if name == "br":
            runs.append((stack[-1], block, " "))
        if name in VOID:
            continue
        drop, is_main = _judged(name, m.group(3) or m.group(6) or "")
        names.append(name)
        parents.append(stack[-1])
        dropped.append(drop)
        main.append(is_main)
        if name in OPAQUE:
            end = _CLOSING[name].search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        stack.append(len(names) - 1)
        counts[name] = counts.get(name, 0) + 1
    return Page(names, parents, dropped, main, [(i, b, html.unescape(t)) for i, b, t in runs])


def _hashes(p: Page) -> list[int]:
    """Hash of every element with text, as signed 64 bits; 0 for those without any."""
    out = [0] * len(p.names)
    own: list[list[tuple[int, bytes]]] = [[] for _ in p.names]
    for order, (i, _, text) in enumerate(p.runs):
        if said := " ".join(text.split()):
            own[i].append((order, said.encode("utf-8", "replace")))
    for i in range(len(p.names) - 1, -1, -1):  # children come after their parents, so they are done before them
        if own[i]:
            own[i].sort()
            h = xxhash.xxh64_intdigest(b"\0".join([p.names[i].encode(), *(b for _, b in own[i])]))
            out[i] = h - (1 << 64) if h >= 1 << 63 else h
            if p.parents[i] >= 0:
                own[p.parents[i]].append((own[i][0][0], b"\1" + h.to_bytes(8, "little")))
    return out


def subtrees(page: str) -> list[tuple[int, int]]:
    """(hash, hash of the parent) of the block elements with text, each once; the body's parent is the page."""
    p = parse(page)
    hashes = _hashes(p)
    return list({(hashes[i], hashes[p.parents[i]]) for i in range(1, len(hashes)) if hashes[i] and p.names[i] in BLOCKS and p.names[i] not in ("html", "head", "body")})


def main_text(page: str, templates: Container[int] = ()) -> str:
    """The blocks of the main text, joined by newlines, without the subtrees whose hashes are templates."""
    p = parse(page)
    n = len(p.names)
    above = p.parents
    articles = [i for i in range(n) if p.names[i] == "article" or p.main[i]]
    dropped = p.dropped[:]
    for i in range(1, n):
        dropped[i] = dropped[i] or dropped[above[i]]
    if articles and all(dropped[i] for i in articles):  # what holds the only article is no sidebar, whatever its class says
        holds, within = [False] * n, [False] * n
        for i in range(1, n):
            within[i] = within[above[i]] or p.names[above[i]] == "article"
        for i in articles:
            while i >= 0 and not holds[i] and not within[i]:
                holds[i], i = True, above[i]
        for i in range(1, n):
            dropped[i] = p.names[i] in DROPPED or p.dropped[i] and not holds[i] or dropped[above[i]]
    size = [0] * n
    for i, _, text in p.runs:
        size[i] += 0 if dropped[i] else len(text)
    for i in range(n - 1, 0, -1):
        size[above[i]] += size[i]
    outer = [i for i in articles if not dropped[i] and size[i]]
    named = [i for i in outer if p.names[i] == "article"] or outer
    root = max(named, key=lambda i: (size[i], -i), default=0)

    inside, gone, header = [False] * n, dropped, [False] * n
    inside[root] = True
    path = set()
    j = root
    while j >= 0:
        path.add(j)
        j = above[j]
    several = [False] * n
    for i in range(n - 1, 0, -1):
        if p.names[i] in BLOCKS:
            several[above[i]] = True
        several[above[i]] |= several[i]
    hashes = _hashes(p) if templates else [0] * n
    for i in range(1, n):
        up = above[i]
        inside[i] = inside[i] or inside[up]
        header[i] = (header[up] or p.names[i] == "header") and (root == 0 or p.names[i] not in HEADINGS)
        recurs = hashes[i] and hashes[i] in templates and i not in path and p.names[i] in BLOCKS and (root == 0 or several[i])
        gone[i] = gone[i] or gone[up] or bool(recurs)
    blocks: dict[int, list[str]] = {}
    for i, b, text in p.runs:
        if inside[i] and not gone[i] and not header[i]:
            blocks.setdefault(b, []).append(text)
    return "\n".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def site_templates(pages: DataFrame, url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, templates): per host the hashes of subtrees that recur; at most elements per page / ``min_share`` for any host."""
    @F.pandas_udf("array<struct<hash:long,parent:long>>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"hash": h, "parent": q} for h, q in subtrees(t)] for t in texts])

    sites = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("html")).where("host != '' and html != ''")
    found = sites.select("host", F.explode(hashed("html")).alias("s")).select("host", "s.hash", "s.parent")
    counts = found.groupBy("host", "hash", "parent").agg(F.lit(1).alias("one")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = sites.groupBy("host", F.xxhash64("html").alias("h")).agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    often = materialize(counts, "html-recurring").join(materialize(sizes, "html-hosts"), "host").where(F.col("n") >= F.col("pages") * min_share)
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` with their main text and n_chars, its length in code points."""
    templates = materialize(site_templates(pages, url, page, min_pages, min_share).withColumnRenamed("host", "__host"), "html-templates")

    @F.pandas_udf("string")
    def text_of(texts: pd.Series, known: pd.Series) -> pd.Series:
        sets: dict[bytes, frozenset[int]] = {}
        out = []
        for t, k in zip(texts, known, strict=True):
            of_host: Container[int] = ()
            if k is not None:
                key = np.asarray(k, np.int64).tobytes()
                of_host = sets.get(key) or sets.setdefault(key, frozenset(k.tolist()))
            out.append(main_text(t, of_host))
        return pd.Series(out)

    kept = drop_clashing(pages, "text", "n_chars")
    keyed = kept.withColumn("__host", host_of(F.col(f"`{url}`")))
    got = keyed.join(templates, "__host", "left").withColumn("text", text_of(F.coalesce(F.col(f"`{page}`"), F.lit("")), F.col("templates")))
    return got.select(*[F.col(f"`{c}`") for c in kept.columns], "text", F.length("text").cast("long").alias("n_chars"))
