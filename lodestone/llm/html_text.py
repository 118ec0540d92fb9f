"""Main text of web pages by tree scoring.

A page becomes a small tree of elements and a list of text blocks in page order. Paragraph-like blocks give points for
length and commas to their parent, half to the grandparent and a third to the next; an element's points are discounted
by the share of its text that is links. The best container is kept with those siblings that look like more of it.

Elements that look like menus, headers, footers, sidebars, notices, adverts, forms or readers' comments by tag, class,
id or role are left out. A name speaks for itself if all its parts do (sidebar, related-posts); one that also says
something else (related-work, share-prices) is only suspect, and inside the article its text decides. An element that holds
most of the page's points around a container that is nothing of the kind wraps the article, and stays; a notice or an
advert never does. Time and memory are linear in the page, whatever its tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))""", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe svg math textarea select object title canvas video audio".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no article, and words of class or id that say so. A page may still wrap its article in one.
UNLIKELY_TAGS = frozenset("nav footer aside form button dialog fieldset menu head header".split())
SAFE = frozenset("html body main".split())
UNLIKELY = frozenset(
    (
        "ad ads advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs combx community consent cookie cookies copyright "
        "foot footer gdpr head header legal login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup "
        "promo promotion related recommended rss search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags toolbar tools "
        "widget alert overlay"
    ).split()
)
#: Of these, those that never wrap an article.
NOTICES = frozenset("ad ads advert adverts advertisement advertising adsense adbox consent cookie cookies gdpr modal newsletter notice notification popup promo promotion signup sponsor sponsored subscribe alert overlay".split())
HEADERS, HEADINGS = frozenset("head header masthead".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a name that say where an element stands or what it is made of, not what it is about.
NEUTRAL = frozenset(
    (
        "area article articles bar block body bottom box btn button buttons column container content entry global group icon icons inner item items left link links list "
        "main message more news outer page pane panel post posts primary region right row secondary section site slot stories story text title top unit wrap wrapper"
    ).split()
)
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: A word after one of these tells how a page looks, not what an element is.
MODIFIERS = frozenset("has no with without is not".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {tag: (closed.split(), stops.split()) for tag, (closed, stops) in CLOSES.items()}
BONUS = {"article": 25, "main": 25, "section": 2, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
NO_POINTS = frozenset("h1 h2 h3 h4 h5 h6 th figcaption".split())
#: What an element is, and the share of the page's points from which it must be the article's wrapper all the same.
PLAIN, SUSPECT, NAMED, OTHER, COMMENTS, NOTICE, HIDDEN = range(7)
WRAPS = {SUSPECT: 0.5, NAMED: 0.5, OTHER: 0.9, COMMENTS: 0.97}
CONTAINERS = frozenset("div section article main td center form".split())
#: A suspect element of the article stays if less of its text than this is links, and it earns points.
FEW_LINKS = 0.3


def _kind(tag: str, attrs: str, in_article: bool) -> int:
    """PLAIN, or why an element is unlikely: its class, id or role; its tag; readers' comments; hidden."""
    if tag in SAFE:
        return PLAIN
    kind = OTHER if tag in UNLIKELY_TAGS and not (tag == "header" and in_article) else PLAIN
    if not attrs or attrs.isspace():
        return kind
    for name, *value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(value)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return HIDDEN
        if name == "role" and value.lower() in ROLES:
            kind = max(kind, OTHER)
        elif name in ("class", "id"):
            for part in CAMEL.sub("-", value).lower().split():
                w = part.replace("_", "-").split("-")
                if not MODIFIERS.isdisjoint(w[:-1]):
                    continue
                if not READERS.isdisjoint(w):
                    kind = max(kind, COMMENTS)
                elif tag != "article" and tag not in HEADINGS and not UNLIKELY.isdisjoint(w) and not (in_article and HEADERS.issuperset(UNLIKELY.intersection(w))):
                    own = all(x in UNLIKELY or x in NEUTRAL or x.isdigit() for x in w)
                    kind = max(kind, SUSPECT if not own else NAMED if NOTICES.isdisjoint(w) else NOTICE)
    return kind


def _blocks(html: str) -> tuple[list[str], list[int], list[int], list[tuple[int, str, int]]]:
    """Tags, parents and kinds of the elements, and blocks (element, text, characters inside links).

    For each tag the depths of its open elements are kept, so that an end tag is found or not without a search."""
    tags, parents, kinds, stack = ["#root"], [-1], [PLAIN], [0]
    opens: dict[str, list[int]] = {}
    walls = [0]  # depths of the open elements that aren't inline
    blocks: list[tuple[int, str, int]] = []
    run: list[str] = []
    links, at, end = 0, 0, len(html)

    def depth_of(tag: str) -> int:
        held = opens.get(tag)
        return held[-1] if held else 0

    def flush() -> None:
        nonlocal links
        if run:
            text = "".join(run)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((stack[walls[-1]], text, min(links, len(text))))
            run.clear()
        links = 0

    def pop_to(depth: int) -> None:
        for i in reversed(stack[depth:]):
            opens[tags[i]].pop()
        del stack[depth:]
        while walls[-1] >= depth:
            walls.pop()

    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            run.append(html[at:stop])
            if opens.get("a"):
                links += stop - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            depth = depth_of(tag)
            if tag not in RAW and depth and (tag not in INLINE or depth > walls[-1]):
                if tag not in INLINE:
                    flush()
                pop_to(depth)
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            if not attrs.endswith("/"):
                closed = RAW[tag].search(html, at)
                at = closed.end() if closed else end
            continue
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                if tags[stack[walls[-1]]] == "p":
                    pop_to(walls[-1])
            elif tag in CLOSES:
                closing, stops = CLOSES[tag]
                wall = max(map(depth_of, stops))
                while (depth := max(map(depth_of, closing))) > wall:
                    pop_to(depth)
        elif tag == "a" and opens.get("a"):  # a link doesn't hold a link
            pop_to(depth_of("a"))
        tags.append(tag)
        parents.append(stack[-1])
        kinds.append(_kind(tag, attrs, bool(opens.get("article") or opens.get("main"))))
        if not attrs.endswith("/") or tag in INLINE or tag in SAFE or tag in ("p", "article"):
            if tag not in INLINE:
                walls.append(len(stack))
            opens.setdefault(tag, []).append(len(stack))
            stack.append(len(tags) - 1)
    flush()
    return tags, parents, kinds, blocks


def _gain(tag: str, text: str, links: int) -> float:
    """Points of a block for its length and commas, less the share that is links."""
    if len(text) < 25 or tag in NO_POINTS:
        return 0.0
    return (1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)) * (1 - links / len(text))


def _unlikely(tags: list[str], parents: list[int], kinds: list[int], blocks: list[tuple[int, str, int]]) -> tuple[list[bool], list[bool]]:
    """Which elements go for what they are, and which of these only look suspect but read like text.

    One that holds most of the page's points wraps the article and stays, if it does so around a container that is nothing
    unlikely, or if there are no other points. That can't be if an article or main element with text stands outside of
    all unlikely ones; inside such an element, suspect ones that read like text stay."""
    n = len(tags)
    held, size, linked, inner, inside, under = [0.0] * n, [0] * n, [0] * n, [0.0] * n, [False] * n, [False] * n
    for block, text, links in blocks:
        held[block] += _gain(tags[block], text, links)
        size[block] += len(text)
        linked[block] += links
    for i in range(n - 1, 0, -1):
        if kinds[i] == HIDDEN:
            held[i] = size[i] = linked[i] = 0
        for x in (held, size, linked):
            x[parents[i]] += x[i]
        inner[parents[i]] = max(inner[parents[i]], inner[i], held[i] if kinds[i] == PLAIN and tags[i] in CONTAINERS else 0.0)
    reads = [k == SUSPECT and held[i] > 0 and linked[i] < FEW_LINKS * size[i] for i, k in enumerate(kinds)]
    for i in range(1, n):
        inside[i] = inside[parents[i]] or tags[parents[i]] in ("article", "main")
        under[i] = under[parents[i]] or kinds[i] != PLAIN and not (reads[i] and inside[i])
    if any(tags[i] in ("article", "main") and size[i] and not under[i] for i in range(1, n)):
        return [k != PLAIN and not (reads[i] and inside[i]) for i, k in enumerate(kinds)], reads
    wraps = lambda i: kinds[i] in WRAPS and held[i] > WRAPS[kinds[i]] * held[0] and (2 * inner[i] >= held[i] or held[i] >= 0.999 * held[0])
    return [k != PLAIN and not wraps(i) for i, k in enumerate(kinds)], reads


def _below(parents: list[int], own: list[bool]) -> list[bool]:
    """Which elements are marked, or lie in one that is."""
    out = own[:1]
    for i in range(1, len(own)):
        out.append(own[i] or out[parents[i]])
    return out


def main_text(html: str) -> str:
    """The page's main text: its blocks in page order, one to a line; empty if there is none."""
    tags, parents, kinds, blocks = _blocks(html)
    unlikely, reads = _unlikely(tags, parents, kinds, blocks)
    dropped, every = _below(parents, unlikely), blocks
    blocks = [b for b in blocks if not dropped[b[0]]]
    if not blocks:
        return ""
    n = len(tags)
    points, length, linked, count = [0.0] * n, [0] * n, [0] * n, [0] * n
    for block, text, links in blocks:
        length[block] += len(text)
        linked[block] += links
        count[block] += 1
        gain = _gain(tags[block], text, links)
        holder, share = (parents[block] if tags[block] in ("p", "pre", "blockquote", "li", "dd", "dt") else block), 1
        while holder > 0 and share <= 3:
            points[holder] += gain / share
            holder, share = parents[holder], share + 1
    for i in range(n - 1, 0, -1):  # children come after their parents
        for x in (length, linked, count):
            x[parents[i]] += x[i]
    density = [b / a if a else 0.0 for a, b in zip(length, linked, strict=True)]
    score = [(p + BONUS.get(t, 0)) * (1 - d) if p > 0 else 0.0 for p, t, d in zip(points, tags, density, strict=True)]
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        named = [i for i in range(n) if tags[i] in ("article", "main") and length[i]]
        best = named[0] if named else 0
    else:
        up = parents[best]
        while up > 0:  # the article that the best part belongs to
            if tags[up] in ("article", "main") and density[up] < 0.5:
                best = up
            up = parents[up]
    kept = {best}
    if best and tags[best] not in ("body", "html"):
        need = max(10.0, 0.2 * score[best])
        for i in range(1, n):
            if i != best and parents[i] == parents[best] and length[i]:
                alone = tags[i] == "p" and (length[i] > 80 and density[i] < 0.25 or length[i] <= 80 and not linked[i] and length[i] > 25)
                if score[i] >= need and density[i] < 0.5 or alone:
                    kept.add(i)
    held = _below(parents, [i in kept for i in range(n)])
    dropped = _below(parents, [u and not (reads[i] and held[i]) for i, u in enumerate(unlikely)])  # what only looked suspect, inside the article
    inside = [False] * n
    for i in range(n):
        menu = i not in kept and tags[i] in ("ul", "ol", "table", "dl") and count[i] > 1 and density[i] > 0.8
        inside[i] = (i in kept or i > 0 and inside[parents[i]]) and not menu
    return "\n".join(text for block, text, _ in every if inside[block] and not dropped[block])


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns keep, text and n_chars for each row of pages.

    A null or empty page gives an empty text, text without any markup is its own main text, and rows that repeat are
    returned as often as they come. Columns of pages that aren't kept may have any name."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) if h else "" for h in b.column(b.num_columns - 1).to_pylist()]
            cols = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = [*keep, "text", "n_chars"]
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(of, f"{schema}, text string, n_chars long")
