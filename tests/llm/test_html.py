import random
import time

import pytest

from lodestone.llm import html_text as H

P1 = "A first paragraph, with commas, that is long enough to earn some points."
P2 = "A second paragraph, which is also long enough, and follows it."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("a < b &amp; c", "a < b & c"),
        (f"<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>{P1}<p>{P2}</article><footer>f</footer>", f"T\n{P1}\n{P2}"),
        (f"<div id=main><p>{P1}</p><p><b>x</b>&nbsp;\n y</p></div><div class='comments'><p>{P2} {P2}</p></div>", f"{P1}\nx y"),
        (f"<div><p>{P1}</p><aside>{P2}</aside><form>{P2}</form><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- {P2} --></div>", P1),
        (f"<main><section><p>{P1}</p></section><section><p>{P2}</p></section></main><div class=ad>{P2}</div>", f"{P1}\n{P2}"),
        (f"<article><p>{P1}</p><ul><li><a href=1>Related one</a></li><li><a href=2>Related two</a></li></ul></article>", P1),
        (f"<article><p>{P1}", P1),
        ("<article><p>Short.</p></article>", "Short."),
        (f"<article><p>{P1}</p><p>cut <b", f"{P1}\ncut"),
    ],
)
def test_main_text(html, text):
    assert H.main_text(html) == text


@pytest.mark.parametrize(
    "html",
    [
        f'<div class="content has-sidebar"><p>{P1}</p><p>{P2}</p></div>',
        f'<div id="page" class="with-banner"><main><p>{P1}</p><p>{P2}</p></main></div>',
        f'<article class="post tags-x share"><p>{P1}</p><p>{P2}</p></article>',
        f'<form id="aspnetForm"><div><p>{P1}</p><p>{P2}</p></div></form>',
        f'<div><p title="the hidden truth">{P1}</p><p>{P2}</p></div>',
        f'<div class="header-wrapper"><div class="content"><p>{P1}</p><p>{P2}</p></div></div><div class="footer"><p>Contact us, by mail or phone, any day.</p></div>',
        f'<article><header><span>by</span></header><p>{P1}</p><p>{P2}</p><footer><p>{P2}</p></footer></article>'.replace("<span>by</span>", ""),
        f'<article><p>{P1}</p><p>{P2}</p></article><section id="comments"><article class="comment-body"><p>{P1} Indeed, it is so, I say.</p></article></section>',
        f'<div><p>{P1}</p><p>{P2}</p></div><p hidden>{P1}</p><p style="display: none">{P2}</p><div aria-hidden="true">{P1}</div>',
        f'<div><p>{P1}<p>{P2}</div><div role="complementary"><p>{P2}</p></div>',
    ],
)
def test_wrappers_and_modifiers(html):
    assert H.main_text(html) == f"{P1}\n{P2}"


def test_a_short_article_beats_a_long_advert():
    assert H.main_text(f'<div class="ad">{P1}</div><article><h1>T</h1><p>Short.</p></article><footer>{P2}</footer>') == "T\nShort."


LONG = "A long and winding notice, with many commas, so that it earns points, and more points, than the short text beside it does, whatever else is said, here or elsewhere."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<article><div class="entry-header"><h1>Title</h1></div><p>{P1}</p></article>', f"Title\n{P1}"),
        (f'<div class="content"><h2 class="section-header">Sub</h2><p>{P1}</p><p>{P2}</p></div>', f"Sub\n{P1}\n{P2}"),
        *[(f"<{outer}><p>{P1}</p><{tag}><h2>S</h2><p>{P2}</p></{tag.split()[0]}></{outer.split()[0]}>", f"{P1}\nS\n{P2}") for outer in ("article", "main", 'div class="content"') for tag in ('section class="related-work"', 'section id="share-prices"', 'section id="search-algorithms"', 'div class="social-history"', 'div class="legal-analysis"')],
        *[(f"<{outer}><p>{P1}</p><p>{P2}</p><{tag}><p>{P2}</p></div></{outer.split()[0]}>", f"{P1}\n{P2}") for outer in ("article", 'div class="content"') for tag in ('div class="related-posts"', 'div class="share-buttons"', 'div id="newsletter"', 'div class="post-footer"', 'div class="ad-slot-2"')],
        (f'<article><p>{P1}</p><div class="related-work"><a href=1>{P1}</a> <a href=2>{P2}</a></div></article>', P1),
        (f'<div class="cookie-consent"><p>{LONG}</p><p>{LONG}</p></div><div><p>{P1}</p></div>', P1),
        (f'<div class="cookie-consent"><div><p>{LONG}</p><p>{LONG}</p></div></div><div><p>{P1}</p></div>', P1),
        (f'<div class="sidebar"><p>{LONG}</p><p>{LONG}</p></div><div><p>{P1}</p></div>', P1),
        (f'<div class="sidebar-layout"><div class="content"><p>{P1}</p><p>{P2}</p></div></div><p>Short.</p>', f"{P1}\n{P2}"),
        (f'<div class="menu"><p>{P1}</p><p>{P2}</p></div>', f"{P1}\n{P2}"),
    ],
)
def test_names_and_wrappers(html, text):
    assert H.main_text(html) == text


def plain_best(tree):
    """The element of the highest score, by walking a tree of (tag, children or text) as the method says."""
    scores, order = {}, []

    def walk(node, path):
        tag, inner = node
        me = path + [len(order)]
        order.append(tag)
        scores[me[-1]] = [0.0, 0]
        if isinstance(inner, str):
            gain = 1 + inner.count(",") + min(len(inner) / 100, 3) if len(inner) >= 25 else 0
            for share, holder in enumerate(reversed(path[-3:]), 1):
                scores[holder][0] += gain / share
        else:
            for child in inner:
                walk(child, me)

    walk(tree, [])
    value = {i: (p + H.BONUS.get(order[i], 0) if p > 0 else 0.0) for i, (p, _) in scores.items()}
    return max(value, key=lambda i: (value[i], -i))


def test_scores_of_small_trees():
    rng = random.Random(8)
    seen = 0
    for _ in range(300):
        def tree(depth):
            if depth == 0 or rng.random() < 0.3:
                return ("p", f"t{rng.randrange(10**9)} " + "word, " * rng.randint(1, 12) + "end")
            return (rng.choice(["div", "section", "center"]), [tree(depth - 1) for _ in range(rng.randint(1, 3))])

        root = ("div", [tree(3) for _ in range(2)])
        texts, number = [], [0]

        def html(node, inside):
            me = number[0]
            number[0] += 1
            inside = inside or me == best
            if isinstance(node[1], str):
                texts.append((inside, node[1]))
                return f"<{node[0]}>{node[1]}</{node[0]}>"
            return f"<{node[0]}>" + "".join(html(c, inside) for c in node[1]) + f"</{node[0]}>"

        best = plain_best(root)
        out = H.main_text(html(root, False))
        want = [t for inside, t in texts if inside]
        assert all(t in out.split("\n") for t in want)
        seen += len(want) < len(texts)
    assert seen > 20


@pytest.mark.parametrize("part", ["<div></x>", "<b></i>", "<p><b></div>", "<li></ul>", "<td><a>", "<tr></table>", "<div class='ad x'>", "<a href='", '<a "'])
def test_hostile_pages_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 8


def test_hard_input():
    assert H.main_text("<" * 20000) == "<" * 20000
    assert H.main_text("<a " + 'x="' * 5000) is not None
    assert H.main_text("<div>" * 3000 + P1) == P1


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{P1}</p></article>", "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "v", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((tuple(r) for r in H.extracted(df).collect()), key=str)
    assert out == sorted([(1, "u", P1, len(P1)), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert H.extracted(df.limit(0)).collect() == []
