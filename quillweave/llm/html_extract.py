"""HTML extraction with a site style tree.

All pages of a host are merged into one tree of styles: a node is a path of tags with their class, id and role. For
each style node the number of pages that have it is counted, the pages for each presentation (the sequence of its
children's styles) and, for nodes with text of their own, the pages for each text. A node's presentations are important
if they differ between pages (their entropy, in units of the largest possible); its texts are if they are not the same
on page after page (one minus the mean entropy of where a text occurs). A node's importance joins both with that of
what it contains, less and less with depth. A branch is noise if its node and all nodes below are of low importance.

Entropy alone can't tell a menu of ever new links from an article, nor a host's only article, copied to two pages, from
a footer. What authors say therefore comes first: elements and names that say navigation, advert, form, notice or
comment bound a style node's importance by 0, whatever the entropies. Article and main elements are a prior, that of
PRIOR pages: of importance 1 for what they hold, 0 for what is around them. Branches and texts inside go if the tree finds
them unimportant all the same, blocks around them stay if it finds them important and they aren't links. Articles with
less than a quarter of a page's text are no prior for the rest. Entropy decides about all other nodes. Names count as
whole tokens of class and id; they don't count on what is or holds the page's article, and those of a page's frame not
inside one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, scratch, table

#: Importance below which a branch is noise.
LOW = 0.2
#: Weight of contents against presentation, to the power of the number of presentations.
DAMPING = 0.9
#: Importance from which a block around an article is text.
HIGH = 0.5
#: Pages that an article element's word counts for.
PRIOR = 5
#: Pages that speak against noise anywhere, and from how many on a style can be noise for all that: 1 / (1 + 5) < LOW.
AGAINST, PAGES = 1, 5

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "annotation", "annotation-xml"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul button object audio video canvas label datalist".split()
)
_NOISE_TAGS = set("head script style textarea title iframe noembed noframes noscript template svg object audio video canvas select option optgroup datalist button nav footer aside dialog menu search input".split())
_NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Noise unless they hold the page's article, as names that say noise are.
_HOLDERS = {"form", "fieldset"}
#: Names that say noise.
_NOISE_NAMES = set("ad ads adv advert adverts advertisement advertising advertorial adsense sponsor sponsored promo promoted comment comments commentlist disqus respond reply replies cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager skiplink captcha paywall outbrain taboola".split())
#: Names that also stand on what is around an article: they don't count there.
_FRAME_NAMES = set("sidebar sidebars nav navbar navigation menu menus topbar toolbar header masthead footer foot banner widget widgets notice notices alert aside search toc tags".split())
#: Parts of names that go with those that say noise: newsletter-signup-box.
_PLAIN_NAMES = set("area bar block box button buttons container form group icon icons inline inner item items link links list panel row section small text widget wrap wrapper".split())
#: Characters, and one part of a page's text, that such an element has at most inside an article.
MINOR, MINOR_PART = 200, 10
_CLOSES_P = _BLOCKS - {"p", "head", "html", "body", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup", "label", "legend", "svg", "button", "object", "audio", "video", "canvas", "select", "template", "datalist"} | {"p"}
_P_SCOPE = {"p", "button", "td", "th", "caption", "table", "object", "template"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class Node:
    """soft: 1 if its name or tag says what is around an article, 2 if only a part of a name says that or noise; minor: whether
    all parts of a name say noise, or what a page puts it in."""

    @property
    def main_article(self) -> bool:
        return self.main and self.tag != "main"

    __slots__ = ("tag", "parent", "path", "style", "hard", "named", "soft", "minor", "main", "names", "link", "children", "texts", "tags", "scope")

    def __init__(self, tag: str, parent: Node | None, name: str, hard: bool, named: bool, soft: int, minor: bool, main: bool):
        self.tag, self.parent, self.hard, self.named, self.soft, self.minor, self.main = tag, parent, hard, named, soft, minor, main
        self.names = name.lower().partition(".")[2].rpartition("#")[0]
        self.style = xxhash.xxh64_intdigest(name) >> 1
        self.path = xxhash.xxh64_intdigest(f"{parent.path if parent else 0}/{name}") >> 1
        self.link = False  # whether half of its text is links
        self.children: list[Node] = []
        self.texts: list[str] = []
        # What is open here, and the innermost element that an open p doesn't reach beyond: no walk up is needed for them.
        self.tags: frozenset[str] = frozenset((tag,)) if parent is None else parent.tags if tag in parent.tags else parent.tags | {tag}
        self.scope: Node = self if parent is None or tag in _P_SCOPE else parent.scope


def _open(tag: str, attributes: str, parent: Node) -> Node:
    a = {k.lower(): x or y or z or "" for k, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
    role, said = a.get("role", "").lower(), f"{a.get('class', '')} {a.get('id', '')}"
    names = set(said.lower().split())
    parts = {x.lower() for x in _NAME.findall(said)} if names else names
    outside = tag in ("html", "body")
    hard = tag in _NOISE_TAGS or role in _NOISE_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
    hard = hard or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
    named = not outside and (tag in _HOLDERS or bool(names & _NOISE_NAMES))
    main = not hard and (tag in ("article", "main") or role in ("main", "article") or "articlebody" in a.get("itemprop", "").lower())
    # A header may be a page's, which is noise, or an article's, which holds its title.
    soft = 0 if outside or main else 1 if names & _FRAME_NAMES or tag == "header" else 2 if parts & (_FRAME_NAMES | _NOISE_NAMES) else 0
    minor = not (outside or main) and any(len(x) > 1 and x & _NOISE_NAMES and x <= _NOISE_NAMES | _PLAIN_NAMES for x in ({y.lower() for y in _NAME.findall(n)} for n in said.split()))
    # Ids that differ in numbers, as post-17 and post-18, are one style; classes say more.
    style = " ".join(sorted([*a.get("class", "").split(), *_DIGITS.sub("0", a.get("id", "")).split()]))
    return Node(tag, parent, f"{tag}.{style}#{role}", hard and not outside, named, soft, minor, main)


def _settle(root: Node, blocks: list[tuple[Node, str, bool]]) -> None:
    """Lift names from what is or holds a page's article, and let names on the others decide."""
    held: Counter = Counter()
    linked: Counter = Counter()
    for node, text, link in blocks:
        held[node] += len(text)
        linked[node] += len(text) * link
    order, tops, todo = [], [], [(root, False, False)]
    while todo:
        node, hard, inside = todo.pop()
        order.append(node)
        hard |= node.hard
        if node.main and not inside and not hard:
            tops.append(node)
        # A hidden or navigation branch's text isn't text of the page.
        todo += [(c, hard, inside or node.main) for c in node.children]
        if hard:
            held[node] = 0
    for node in reversed(order):
        if node.parent:
            held[node.parent] += held[node]
            linked[node.parent] += linked[node]
    for node in order:
        node.link = 2 * linked[node] >= held[node] > 0
    _others(order, held, linked)
    for node in order:  # the text of an article that isn't marked as one, in a wrapper that has a part of a name
        if node.soft == 2 and 2 * held[node] >= held[root]:
            node.soft = 0
    for top in tops:
        if any(_up(top, "named")) and 2 * held[top] < held[root]:
            continue
        up = top
        while up is not None:  # what is or holds an article isn't noise or a frame, whatever its name
            up.named, up.soft, up.minor = False, 0, False
            up = up.parent
    for node in order:
        if node.named or (node.minor and held[node] <= MINOR and MINOR_PART * held[node] <= held[root]):
            node.hard, node.main = True, False


def _others(order: list[Node], held: Counter, linked: Counter) -> None:
    """Article elements that aren't a page's: beside a larger one, what is short and holds a link is a teaser; elsewhere, as in a
    section after it, what has less than half of its text is a comment or a teaser."""
    articles = [x for x in order if x.main and x.tag != "main" and held[x] and not any(_up(x.parent, "main_article"))]
    if len(articles) < 2:
        return
    big = max(articles, key=lambda x: held[x])
    around, up = set(), big.parent
    while up is not None:
        around.add(up)
        up = up.parent
    for x in articles:
        if x is not big and (2 * held[x] < held[big] if x.parent not in around else 4 * held[x] < held[big] and linked[x]):
            x.named = True


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool]]]:
    """The tree of a page's block elements and its blocks of text, in order, each with the element it stands in
    and whether half of it is links.

    Inline elements and br don't make nodes; a block ends where a block element starts or ends. White space is one
    space, character references are decoded, comments and what isn't text are left out.
    """
    root = Node("#page", None, "#page", False, False, 0, False, False)
    here, blocks, run, at, size, links, linked = root, [], [], 0, len(page), 0, False

    def flush() -> None:
        nonlocal links
        if run:
            text = "".join(run)
            run.clear()
            part, links = links / max(1, len(text)), 0
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                here.texts.append(text)
                blocks.append((here, text, part >= 0.5))

    while at < size:
        start = page.find("<", at)
        if start < 0:
            run.append(page[at:])
            break
        if start > at:
            run.append(page[at:start])
            links += (start - at) * linked
        m = _TOKEN.match(page, start) or _BROKEN.match(page, start)
        if not m:
            run.append("<")
            at = start + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        tag = m[2].lower()
        if tag in _RAW and not m[1]:
            if tag not in ("script", "style"):
                run.append(" ")
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at) if tag != "plaintext" else None
            at = end.end() if end else size
            continue
        if tag == "a":
            linked = not m[1]
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag not in _BLOCKS:
            continue
        flush()
        if m[1]:
            if tag in here.tags:
                while here.tag != tag:
                    here = here.parent
                here = here.parent or root
            continue
        if tag in _CLOSES_P and here.scope.tag == "p":
            here = here.scope.parent
        if tag in _SAME and not here.tags.isdisjoint(_SAME[tag]):
            up, found = here, None
            while up.parent is not None and up.tag not in _WALLS[tag]:
                if up.tag in _SAME[tag]:
                    found = up
                up = up.parent
            if found is not None:
                here = found.parent
        if tag in _VOID:
            continue
        node = _open(tag, m[3], here)
        here.children.append(node)
        if not (m[3] or "").rstrip().endswith("/") or tag != "svg":
            here = node
    flush()
    _settle(root, blocks)
    return root, blocks


def _up(node: Node | None, what: str) -> Iterator[bool]:
    while node is not None:
        yield getattr(node, what)
        node = node.parent


def _flags(root: Node, noise: frozenset[int], boiler: frozenset[int]) -> dict[Node, tuple[bool, bool, int, int, bool]]:
    """Of each element: whether it or what holds it is hard, a frame, noise or stale, and whether it is in an article.

    A style that is noise, or stale, itself has 2, one below such a style 1: too few pages have it for the tree to know.

    A frame's name doesn't count in an article; that of a header, or in parts, not in a main element either. An article
    isn't stale by what is around it, nor itself: then the page is a copy.
    """
    out, todo = {}, [(root, (False, False, 0, 0, False), False)]
    while todo:
        node, (hard, soft, low, stale, main), article = todo.pop()
        header = node.tag == "header" or node.soft == 2 or bool({"header", "masthead", "banner"} & set(node.names.split()))
        framed = bool(node.soft) and not (article or (header and main))
        soft = framed or (soft and not node.main)
        stale = 0 if node.main else 2 if node.path in boiler else min(stale, 1)
        low = 2 if node.path in noise else min(low, 1)
        out[node] = flags = hard or node.hard, soft, low, stale, main or node.main
        article |= node.main and node.tag != "main"
        todo += [(c, flags, article) for c in node.children]
    return out


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def styles(root: Node) -> set[tuple[int, int, int, int]]:
    """(path, parent's path, kind, feature) of a page: kind 0 its presence and bound, 1 a presentation, 2 a text.

    The bound is 2 of what names say is noise, below which nothing is counted, 1 of what is links, else 0.
    """
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        above = node.parent.path if node.parent else 0
        out.add((node.path, above, 0, 2 if node.hard else int(node.link)))
        if node.hard:
            continue
        sequence = [c.style for i, c in enumerate(node.children) if not i or c.style != node.children[i - 1].style]
        out.add((node.path, above, 1, xxhash.xxh64_intdigest(repr(sequence)) >> 1))
        for text in node.texts:
            out.add((node.path, above, 2, xxhash.xxh64_intdigest(text) >> 1))
        todo += node.children
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: Counter = Counter()
        for url, page in zip(batch.column("url"), batch.column("html")):
            if text := page.as_py():
                name = host(url.as_py())
                n.update((name, *x) for x in styles(parse(text)[0]))
        if n:
            cols = [pa.array(x, t) for x, t in zip(zip(*n), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.record_batch([*cols, pa.array(n.values(), pa.int64())], ["host", "path", "above", "kind", "feature", "n"])


def importance(nodes: list[tuple[int, int, int, int, float, float, int, float, int]], damping: float = DAMPING) -> tuple[dict[int, float], dict[int, float]]:
    """Importance of each style node of a host, and the largest of it and of all nodes below it.

    A node: path, parent's path, bound, pages, sum of pages over presentations and of n log n over them, number of texts
    and sum of log n over them, and pages of children of too rare a style to be nodes, unless they are links. Those count as one child that is as
    important as can be; of all below, to the part of the node's pages that have one.
    """
    own, below = {}, defaultdict(list)
    for path, above, bound, pages, total, sums, texts, logs, rare in nodes:
        own[path] = (bound, pages, total, sums, texts, logs, rare)
        below[above].append(path)
    out: dict[int, float] = {}
    most: dict[int, float] = {}
    order, todo = [], [p for p, above in ((x[0], x[1]) for x in nodes) if above not in own]
    while todo:
        path = todo.pop()
        order.append(path)
        todo += [x for x in below[path] if x != path]
    for path in reversed(order):
        bound, pages, total, sums, texts, logs, rare = own[path]
        inside = [(1.0, rare)] * bool(rare) + [(out[x], own[x][1]) for x in below[path] if x in out]
        if texts:
            inside.append((1 - logs / texts / log(pages) if pages > 1 else 1.0, pages))
        shown = min(1.0, (log(total) - sums / total) / log(pages)) if pages > 1 and total else 1.0
        children = len(below[path]) + bool(rare)
        share = damping ** max(1, children)
        held = sum(x * n for x, n in inside) / sum(n for _, n in inside) if inside else 0.0
        out[path] = 0.0 if bound else (1 - share) * shown * bool(children) + (share if children else 1.0) * held
        most[path] = max([out[path], 0.0 if bound else min(1.0, rare / pages), *(most[x] for x in below[path] if x in most)])
    return out, most


def _noise(low: float):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        cols = ["path", "above", "bound", "pages", "total", "sums", "texts", "logs", "rare"]
        out, most = importance(list(nodes[cols].itertuples(index=False, name=None)))
        pages = dict(zip(nodes["path"], nodes["pages"]))
        noise = [int(p) for p, x in most.items() if AGAINST + pages[p] * x < low * (AGAINST + pages[p])]
        boiler = [int(p) for p, x in most.items() if PRIOR + pages[p] * x < low * (PRIOR + pages[p])]
        sure = [int(p) for p, x in out.items() if pages[p] * x >= HIGH * (PRIOR + pages[p])]
        return pd.DataFrame({"host": nodes["host"].iloc[0], "noise": [noise], "boiler": [boiler], "sure": [sure]})

    return run


def style_trees(pages: DataFrame, low: float = LOW) -> DataFrame:
    """host, noise, boiler, sure: for each host the paths of style nodes of low importance, of those of low importance
    even in an article, with single texts that a host repeats there, and of high importance, from its pages (url, html).

    All pages are counted. A host's tree is put together in one task from its styles' sums, not from its pages; styles
    of fewer than PAGES pages, which can't be noise, are one child of what holds them there.
    """
    home = scratch(pages.sparkSession, "styles")
    counts = pages.select("url", "html").transform(arrow, _count, "host string, path long, above long, kind int, feature long, n long")
    counts = table(counts.groupBy("host", "path", "above", "kind", "feature").agg(F.sum("n").alias("n")), f"{home}/counts")
    n, kind = F.col("n"), F.col("kind")

    def total(of: int, what):
        return F.coalesce(F.sum(F.when(kind == of, what)), F.lit(0))

    nodes = counts.groupBy("host", "path", "above").agg(
        F.when(total(0, F.when(F.col("feature") == 2, n)) * 2 > total(0, n), 2).otherwise(0).alias("bound"), total(0, n).alias("pages"), total(0, F.when(F.col("feature") == 0, n)).alias("plain"), total(1, n).alias("total"), total(1, n * F.log(n)).alias("sums"), total(2, F.lit(1)).alias("texts"), total(2, F.log(n)).alias("logs")
    )
    nodes = table(nodes, f"{home}/nodes")
    few = nodes.where(F.col("pages") < PAGES).groupBy("host", F.col("above").alias("path")).agg(F.sum(F.when(F.col("bound") == 0, F.col("plain")).otherwise(0)).alias("rare"))
    nodes = nodes.where(F.col("pages") >= PAGES).join(few, ["host", "path"], "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    nodes = table(nodes, f"{home}/known")
    trees = nodes.groupBy("host").applyInPandas(_noise(low), "host string, noise array<long>, boiler array<long>, sure array<long>")
    # A text's entropy is judged like a branch's; most pages must have it, as near copies of an article share texts too.
    often = counts.where((kind == 2) & (n >= 2 * PAGES)).select("host", "path", "feature", "n").join(nodes.where("bound = 0").select("host", "path", "pages"), ["host", "path"])
    rare = often.where(PRIOR + F.col("pages") * (1 - F.log("n") / F.log("pages")) < low * (PRIOR + F.col("pages"))).where(2 * F.col("n") > F.col("pages"))
    texts = rare.groupBy("host").agg(F.collect_list(F.col("path").bitwiseXOR(F.col("feature"))).alias("more"))
    trees = trees.join(texts, "host", "left").withColumn("boiler", F.concat("boiler", F.coalesce("more", F.array().cast("array<long>")))).drop("more")
    return table(trees, f"{home}/trees")


def main_text(page: str, noise: frozenset[int] = frozenset(), boiler: frozenset[int] = frozenset(), sure: frozenset[int] = frozenset()) -> str:
    """A page's blocks that are text of its article, joined by an empty line."""
    root, blocks = parse(page)
    known = _flags(root, noise, boiler)
    inside = sum(len(text) for node, text, _ in blocks if known[node][4] and not known[node][0])
    total = sum(len(text) for node, text, linked in blocks if not any(known[node][:2]) and (known[node][4] or known[node][2] <= (not linked)))
    article = inside > 0 and 4 * inside >= total
    out, stay = [], []
    for node, text, linked in blocks:
        hard, soft, low, stale, main = known[node]
        if hard:
            continue
        # What the tree doesn't know goes with what holds it if it is links.
        low, stale = low > (not linked), stale > (not linked)
        good = node.path in sure and not linked
        again = bool(boiler) and (node.path ^ (xxhash.xxh64_intdigest(text) >> 1)) in boiler
        if article and main:
            if not soft:
                stay.append(text)
                if not stale and not again:
                    out.append((text, True))
        elif not again and (good and not soft if article else not low and (not soft or good) and not (main and linked)):
            out.append((text, False))
    if article and not any(main for _, main in out):
        return "\n\n".join(stay)
    return "\n\n".join(text for text, _ in out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            known: dict[str, list[frozenset[int]]] = {}
            texts = []
            for url, page, *trees in zip(*(part.column(c) for c in ("url", "html", "noise", "boiler", "sure"))):
                name = host(url.as_py())
                if name not in known:
                    known[name] = [frozenset(x.as_py() or ()) for x in trees]
                texts.append(main_text(page.as_py() or "", *known[name]))
            cols = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch(cols, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null and empty html give an empty text; html without elements is one block. Pages of a null url, or one without a
    host, share a tree. Repeated rows are kept and weigh each; an empty table gives an empty result; other columns are
    ignored, whatever their names. n_chars counts code points. Very long and deeply nested pages take time in proportion.
    """
    name = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    trees = style_trees(pages, low)
    rows = pages.select("page_id", "url", "html", name.alias("host")).join(trees, "host", "left").select("page_id", "url", "html", "noise", "boiler", "sure")
    return rows.transform(arrow, _extract, "page_id long, url string, text string, n_chars long")
