"""Styles of few pages, article elements that aren't a page's, names of small parts; trees against plain ones."""

import math
import random
from collections import Counter, defaultdict

import pytest

from quillweave.llm import html_extract


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))


MENU = '<div class="top"><a href="/a">Home</a> <a href="/b">News</a></div><div class="terms">All rights reserved by the owner of this page</div>'


def extracted(spark, rows):
    return {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("pages", [3, 12, 40])
@pytest.mark.parametrize("mark", ["<div id=post-{i}>", "<div id='{w}'>", "<div class='entry {w}' id=p{i}>", "<section class=s{i}><div id='{w}'>"])
def test_articles_in_elements_of_their_own(spark, pages, mark):
    rng, rows, want = random.Random(pages), [], {}
    for i in range(pages):
        body = [words(rng, 30), words(rng, 20)]
        want[i] = "\n\n".join(body)
        rows.append((i, f"http://h{pages}/p{i}", f"<html><body>{MENU}<div class=wrap>{mark.format(i=i, w=words(rng, 1))}<p>{body[0]}</p><p>{body[1]}</p></div></div></body></html>"))
    got = extracted(spark, rows)
    assert all(want[i] in got[i] for i in want)
    if pages == 40:
        assert all(got[i] == want[i] for i in want)  # by then the tree knows the menu and the terms


def test_menus_of_rare_items_go(spark):
    """Items with ids of their own are links in a branch that the tree knows."""
    rng = random.Random(2)
    rows = [(i, f"http://m/{i}", f"<div class=nv><ul class=l><li><a href=/1>Home page of all</a></li><li id='{words(rng, 1)}'><a href=/{i}>{words(rng, 2)}</a></li></ul></div><div class=wrap><div id='{words(rng, 1)}'><p>text {words(rng, 25)}</p></div></div>") for i in range(60)]
    got = extracted(spark, rows)
    assert all(x.startswith("text ") and "Home" not in x for x in got.values())


def test_articles_that_are_not_the_page():
    rng = random.Random(3)
    body, more = f"<p>{words(rng, 80)}</p>", words(rng, 12)
    t = html_extract.main_text
    main = t(f"<article>{body}</article>")
    comment = f"<article><p>{more}</p></article>"
    assert t(f"<body><article>{body}</article><section class=discussion><h2>Discussion</h2>{comment}{comment}</section></body>") == main
    assert t(f"<main><article>{body}</article><ol>{comment}</ol></main>") == main
    teaser = f"<article><h3><a href=/x>{words(rng, 6)}</a></h3><p>{more}</p></article>"
    assert t(f"<div><article>{body}</article>{teaser}{teaser}</div>") == main
    # Articles of a page of several stay, as do parts of one.
    assert more in t(f"<div><article>{body}</article><article><p>{more}</p></article></div>")
    assert t(f"<div><div><article>{body}</article></div><div><article>{body}</article></div></div>") == f"{main}\n\n{main}"
    assert more in t(f"<article>{body}<article><p>{more}</p></article></article>")
    assert t(f"<div>{teaser}{teaser}{teaser}</div>").count(more) == 3


def test_small_parts_by_compound_names():
    rng = random.Random(4)
    body = words(rng, 120)
    t = html_extract.main_text
    for name in ("newsletter-signup", "share-buttons", "social_share_links", "relatedPostsX newsletterBox", "cookie-consent-bar"):
        assert t(f"<article><p>{body}</p><div class='{name}'>Sign up</div></article>") == body
    for name in ("related-work", "comments-open", "share-enabled", "promo-free", "post-comment-policy"):
        assert t(f"<article><p>{body}</p><div class='{name}'>Sign up</div></article>") == f"{body}\n\nSign up"
    assert t(f"<article><p>{body}</p><div class=share-buttons><p>{body}</p></div></article>") == f"{body}\n\n{body}"  # as long as the rest


def plain_tree(pages):
    """Importance of each style node, and the most of it and below, from all pages of a host."""
    seen, plain, shown, texts, up, hard = Counter(), Counter(), defaultdict(Counter), defaultdict(Counter), {}, Counter()
    for page in pages:
        todo, here = [html_extract.parse(page)[0]], [set(), set(), set(), set(), set()]
        while todo:
            node = todo.pop()
            up[node.path] = node.parent.path if node.parent else 0
            here[0].add(node.path)
            if node.hard:
                here[1].add(node.path)
                continue
            if not node.link:
                here[4].add(node.path)
            styles = [c.style for c in node.children]
            here[2].add((node.path, tuple(x for i, x in enumerate(styles) if not i or x != styles[i - 1])))
            here[3] |= {(node.path, x) for x in node.texts}
            todo += node.children
        seen.update(here[0])
        hard.update(here[1])
        plain.update(here[4])
        for p, x in here[2]:
            shown[p][x] += 1
        for p, x in here[3]:
            texts[p][x] += 1

    def bound(p):
        return 2 * hard[p] > seen[p]

    def judged(p):
        n, children = seen[p], [c for c in seen if up[c] == p and c != p and seen[c] >= html_extract.PAGES]
        rare = sum(plain[c] for c in seen if up[c] == p and c != p and seen[c] < html_extract.PAGES and not bound(c))
        below = [judged(c) for c in children]
        inside = [(x, seen[c]) for c, (x, _) in zip(children, below)] + ([(1.0, rare)] if rare else [])
        if texts[p]:
            inside.append((1 - sum(math.log(x) for x in texts[p].values()) / len(texts[p]) / math.log(n) if n > 1 else 1.0, n))
        total = shown[p].total()
        entropy = -sum(x / total * math.log(x / total) for x in shown[p].values()) if total else 0
        presented = min(1.0, entropy / math.log(n)) if n > 1 and total else 1.0
        held = sum(x * y for x, y in inside) / sum(y for _, y in inside) if inside else 0.0
        k = len(children) + bool(rare)
        share = html_extract.DAMPING ** max(1, k)
        own = 0.0 if bound(p) else (1 - share) * presented + share * held if k else held
        tree[p] = own, max([own, *(m for _, m in below), 0.0 if bound(p) else min(1.0, rare / n)])
        return tree[p]

    tree = {}
    for p in seen:
        if up[p] not in seen and seen[p] >= html_extract.PAGES:
            judged(p)
    return tree, seen


def test_trees_equal_plain_ones(spark):
    rng, pages = random.Random(6), defaultdict(list)
    for i in range(120):
        host = rng.choice(["a", "a", "b", "c"])
        extra = rng.choice(["", f"<div id='{words(rng, 1)}'><p>{words(rng, 3)}</p></div>", "<div class=x><p>same on all</p></div>", "<nav><a>n</a></nav>"])
        pages[host].append(f"<body>{MENU}<div class=wrap>{extra}<p>{words(rng, 9)}</p></div><div class=foot{i % 2}>foot</div></body>")
    rows = [(0, f"http://{h}/", x) for h, xs in pages.items() for x in xs]
    trees = {x.host: x for x in html_extract.style_trees(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h, xs in pages.items():
        tree, seen = plain_tree(xs)
        low, sure = set(), set()
        for p, (own, most) in tree.items():
            n = seen[p]
            if html_extract.AGAINST + n * most < html_extract.LOW * (html_extract.AGAINST + n):
                low.add(p)
            if n * own >= html_extract.HIGH * (html_extract.PRIOR + n):
                sure.add(p)
        assert set(trees[h].noise) == low and set(trees[h].sure) == sure and low and len(low) < len(tree)
