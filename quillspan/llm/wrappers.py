"""Main text of web pages by wrapper induction.

Pages of one host are filled from one template.  A wrapper is induced from up to
SAMPLES of the host's pages, those of least hash: their DOM trees, in which
siblings of one kind are folded into one repeating node, are aligned one after
another by simple tree matching (nodes match when tag and stable names agree,
children in order, for the most nodes in all), and what matches nothing is added.
Every page is then matched with the wrapper, so each of its blocks of text stands
in a slot: the wrapper's node, or the path below one where it matches none.

Slots are described over all distinct pages of the host: on how many they stand,
how long their text is, how much of it is links, how much of it repeats, which
texts are the same on half of the pages.  Each page votes for the region that
holds most of its text; of the regions that a page has, the one with most votes
is its article.  A block goes when the evidence against it is two points or more:

- its text is the same on half of the host's pages (2)
- it is in a part of which half or more is links (2)
- it is outside of the elected region (1)
- its part is short, a quarter of the elected region at most (1)
- more than half of its slot's texts are repeats (1, outside only)
- its part is a list of alike containers, and is outside or marked (1)
- markup names it: nav, form, comments (2); aside, footer, words of a class (1)
- a main heading, or an article or main element, outside of the region and without other marks (-1)

Scripts, styles, controls and what is hidden are no text.  Marks of a part that
holds nearly all of a page aren't counted.  A host of one page is described by
that page: the same rules hold for every size.

Counting is a grouped sum over all pages, so the size of a host does not matter.
Slots on less than a two-hundredth of a host's pages are described by the page
itself, so a host's description is bounded.  Pages meet wrappers and descriptions
by a broadcast of these where they are small, and else by joins on the host and a
salt, with as many salts as a host's pages need.

Defined results: a null or empty page has the empty text; a null url and one
without a host share the host of empty name; repeated rows count once and give
equal rows; of samples of one hash the least page is taken; of regions with
equal votes the page's own choice is taken, then the deepest, then the first; a
text must be the same on three distinct pages at least to be constant, since two
may be copies of one article; elements nested deeper than 150 levels hang on the
last one; an empty table gives an empty result; columns besides id, url and html
are dropped.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, map_batches, text_of, written

#: Pages of a hot host that one salt serves, at least.
SALT_PAGES = 2000
#: Tables of hosts up to these sizes go to all tasks.
BROADCAST_BYTES, MANY_HOSTS = 32_000_000, 200_000
#: Pages that a wrapper is made of, at most.
SAMPLES = 8
#: A text is constant if this share of the host's distinct pages has it there, and so many pages.
SHARE, LEAST_PAGES = 0.5, 3
#: A slot on a smaller share of the host's pages is described by the page itself.
RARE = 0.005
#: The region that holds this share of a page's text gets its vote; a part shorter than that share of the region's text is short.
VOTE, SHORT = 0.6, 0.25
#: Marks of a part with this share of a page's text aren't counted.
WRAPS = 0.8
#: Points at which a block goes.
AGAINST = 2
#: A matched node beside which all equal texts of a page weigh little.
NODE = 1_000_000
#: Longest text that a wrapper's node keeps to hold its place by.
ANCHOR = 80

# Fixed values of HTML: elements without an end tag, those whose text isn't markup, those that end an open paragraph, and those that don't end a block.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "body", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote"}
# Elements that repeat beside each other without being parts of a page.
ITEMS = {"p", "li", "dt", "dd", "tr", "td", "th", "tbody", "option", "a", "b", "i", "em", "strong", "span", "br", "hr", "img", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "meta", "link", "script", "style", "input", "label"}
# What is no text at all: by element.
NO_TEXT = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "head", "svg", "math", "object", "canvas", "audio", "video", "noembed", "noframes", "button", "select"}
# Marks of what isn't article: by element, by role, by the words of a class or id.
STRONG_TAGS, STRONG_ROLES = {"nav", "form", "menu", "dialog"}, {"navigation", "search", "dialog", "alertdialog", "menu", "menubar", "form"}
ASIDE_TAGS, ASIDE_ROLES = {"footer", "aside"}, {"contentinfo", "complementary", "alert"}
HEAD_TAGS, HEAD_ROLES, HEAD_WORDS = {"header"}, {"banner"}, {"header", "masthead", "topbar", "banner"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "footer", "foot", "sidebar", "aside",
    "rail", "widget", "widgets", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "alert", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription",
    "signup", "login", "search", "pagination", "pager", "tags", "copyright", "skip",
}
# Words that may stand beside those in a name without changing what it says.
NEUTRAL_WORDS = {"site", "page", "main", "top", "bottom", "left", "right", "box", "wrap", "wrapper", "container", "block", "area", "section", "inner", "outer", "list", "item", "items", "bar", "global", "primary", "secondary", "wp", "js", "links"}
LANDMARKS = {"article", "main"}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")




class Node:
    __slots__ = ("tag", "names", "role", "hidden", "children", "fold")

    def __init__(self, tag: str, names: tuple[str, ...] = (), role: str = "", hidden: bool = False):
        self.tag, self.names, self.role, self.hidden = tag, names, role, hidden
        self.children: list[Node | str] = []
        self.fold: Fold | None = None

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]

    @property
    def is_text(self) -> bool:
        return self.tag not in NO_TEXT and not self.hidden

    def mark(self) -> int:
        """What markup says: 0 nothing, 1 aside, 2 surely aside, 3 a head, which an article may have too."""
        if self.tag in ("html", "body"):
            return 0
        if self.tag in STRONG_TAGS or self.role in STRONG_ROLES:
            return 2
        words = [[w.lower() for w in _WORDS.findall(name)] for name in self.names]
        if any(w and (w[0] in COMMENT_WORDS or w[-1] in COMMENT_WORDS) for w in words):
            return 2
        if self.tag in ASIDE_TAGS or self.role in ASIDE_ROLES or any(told_by(w, ASIDE_WORDS) for w in words):
            return 1
        return 3 if self.tag in HEAD_TAGS or self.role in HEAD_ROLES or any(told_by(w, HEAD_WORDS) for w in words) else 0


def told_by(words: list[str], listed: set[str]) -> bool:
    """Whether a name says one of the listed words, and besides only neutral ones."""
    return bool(words) and (words[0] in listed or words[-1] in listed) and all(w in listed or w in NEUTRAL_WORDS for w in words)


def parse(page: str) -> Node:
    """The page's tree, as lenient as browsers about what is left open."""
    root = Node("html")
    stack, at = [root], 0

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(s)

    while m := _MARKUP.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in SCOPES and tag not in BLOCKS:
                    break
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in BLOCKS and tag not in ("html", "body"):
            open_p = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == "p" or stack[d].tag in SCOPES), 0)
            if open_p and stack[open_p].tag == "p":
                del stack[open_p:]
        for d in range(len(stack) - 1, 0, -1):
            if stack[d].tag in CLOSES.get(tag, ()):
                del stack[d:]
                break
            if stack[d].tag in SCOPES:
                break
        names, role, hidden = [], "", False
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                value = a[2] or a[3] or a[4] or ""
                if (key := a[1].lower()) == "class":
                    names += value.split()
                elif key == "id" and value:
                    names.append(f"#{value}")
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or key == "aria-hidden" and value == "true":
                    hidden = True
        node = Node(tag, tuple(names), role, hidden)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    text(page[at:])
    return root


def depth_safe(page: str) -> Node:
    """The tree, flattened where it is too deep to be matched: what lies deeper hangs on the last level."""
    root = parse(page)
    level, nodes = 0, [root]
    while nodes:
        level += 1
        if level >= 150:
            for n in nodes:
                flat: list[Node | str] = []
                todo = list(reversed(n.children))
                while todo:
                    c = todo.pop()
                    if not isinstance(c, str):
                        todo += reversed(c.children)
                        c.children = []
                    flat.append(c)
                n.children = flat
            break
        nodes = [c for n in nodes for c in n.children if not isinstance(c, str)]
    return root


class Fold:
    """Siblings of one kind, or one node: label, folded children, whether it repeats; a slot's key once it has one."""

    __slots__ = ("label", "tag", "kids", "runs", "text", "key", "nodes", "number")

    def __init__(self, label: str, tag: str = "", kids: list[Fold] | None = None, runs: bool = False, text: str = ""):
        self.label, self.tag, self.kids, self.runs, self.text = label, tag or label, kids or [], runs, text
        self.key, self.nodes, self.number = 0, [], -1

    def shape(self) -> frozenset[str]:
        return frozenset(f"{k.label}/{x}" for k in self.kids for x in k.shape()) | {k.label for k in self.kids}

    def packed(self) -> list:
        return [self.label, self.tag, self.runs, self.text, [k.packed() for k in self.kids]]


def unpacked(x: list) -> Fold:
    return Fold(x[0], x[1], [unpacked(k) for k in x[4]], x[2], x[3])


def stable_names(pages: list[Node]) -> set[str]:
    """Names on half of the pages or more: others are a page's own, like its number.  Of one page, names without digits."""
    seen: dict[str, int] = {}
    for root in pages:
        todo, own = [root], set()
        while todo:
            n = todo.pop()
            own.update(n.names)
            todo += n.elements
        for name in own:
            seen[name] = seen.get(name, 0) + 1
    if len(pages) == 1:
        return {n for n in seen if not any(c.isdigit() for c in n)}
    return {n for n, k in seen.items() if 2 * k >= len(pages)}


def alike(a: Fold, b: Fold) -> bool:
    """Whether siblings are of one kind: items always are; containers with a name by their make."""
    if a.label != b.label:
        return False
    if a.tag in ITEMS:
        return True
    x, y = a.shape(), b.shape()
    return 2 * len(x & y) >= len(x | y) if a.label != a.tag else x == y


def joined(a: Fold, b: Fold) -> Fold:
    """a, with what b has besides: children of one kind become one, in order."""
    a.nodes += b.nodes
    a.runs, a.text = True, ""
    at = 0
    for k in b.kids:
        j = next((j for j in range(at, len(a.kids)) if alike(a.kids[j], k)), -1)
        if j < 0:
            a.kids.insert(at, k)
            at += 1
        else:
            joined(a.kids[j], k)
            at = j + 1
    return a


def in_runs(kids: list[Fold]) -> list[Fold]:
    """Neighbours of one kind as one: items among items by their label, as a text's paragraphs and headings take turns.

    Containers without a name are only so where three or more stand in a row, or ten without elements.
    """
    found: list[Fold] = []
    items: dict[str, Fold] = {}  # those since the last container
    at = 0
    while at < len(kids):
        k = kids[at]
        if k.tag in ITEMS:
            if k.label in items:
                joined(items[k.label], k)
            else:
                items[k.label] = k
                found.append(k)
            at += 1
            continue
        items = {}
        to = at + 1
        while to < len(kids) and alike(k, kids[to]):
            to += 1
        if to - at > (2 if k.kids else 9) or k.label != k.tag:
            for other in kids[at + 1 : to]:
                joined(k, other)
            found.append(k)
        else:
            found += kids[at:to]
        at = to
    return found


def folded(node: Node, stable: set[str]) -> Fold:
    names = ".".join(sorted({n for n in node.names if n in stable}))
    role = f"[{node.role}]" if node.role else ""
    own = " ".join("".join([c for c in node.children if isinstance(c, str)]).split())
    f = Fold(f"{node.tag}{role}.{names}" if names else node.tag + role, node.tag, in_runs([folded(c, stable) for c in node.elements]), text=own if len(own) <= ANCHOR else "")
    f.nodes = [node]
    return f


def match(a: Fold, b: Fold) -> list[tuple[Fold, Fold]]:
    """Simple tree matching of two trees: pairs of their nodes, the root's first, for the most nodes in all.

    Of matchings with as many nodes, the one with most equal texts is taken: constant nodes hold their places.
    """
    scores: dict[tuple[int, int], tuple[int, list]] = {}

    def score(x: Fold, y: Fold) -> int:
        if x.label != y.label:
            return 0
        key = (id(x), id(y))
        if key in scores:
            return scores[key][0]
        n, m = len(x.kids), len(y.kids)
        alone = NODE + (x.text == y.text != "")
        best = [[0] * (m + 1) for _ in range(n + 1)]
        took = set()
        for i, p in enumerate(x.kids, 1):
            row, above = best[i], best[i - 1]
            for j, q in enumerate(y.kids, 1):
                s = score(p, q)
                row[j] = max(above[j], row[j - 1])
                if s and above[j - 1] + s > row[j]:
                    row[j] = above[j - 1] + s
                    took.add((i, j))
        pairs, i, j = [], n, m
        while i and j:
            if (i, j) in took:
                pairs.append((x.kids[i - 1], y.kids[j - 1]))
                i, j = i - 1, j - 1
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        scores[key] = (alone + best[n][m], pairs[::-1])
        return scores[key][0]

    out: list[tuple[Fold, Fold]] = []
    if score(a, b):
        todo = [(a, b)]
        while todo:
            pair = todo.pop()
            out.append(pair)
            todo += reversed(scores.get((id(pair[0]), id(pair[1])), (0, []))[1])
    return out


def induced(pages: list[str]) -> str:
    """The wrapper of pages, packed: the first one's tree, with what the others have besides."""
    trees = [depth_safe(p) for p in sorted(pages)]
    stable = stable_names(trees)
    wrapper = folded(trees[0], stable)
    for tree in trees[1:]:
        own = folded(tree, stable)
        to = {id(x): (x, y) for x, y in match(own, wrapper)}
        for x, y in to.values():
            y.runs |= x.runs
            place = 0
            for k in x.kids:
                if id(k) in to:
                    place = next(i for i, z in enumerate(y.kids) if z is to[id(k)][1]) + 1
                else:
                    y.kids.insert(place, k)
                    place += 1
    return json.dumps([sorted(stable), wrapper.packed()], ensure_ascii=False)


def hash_of(*parts: object) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) - (1 << 63)


def keyed(wrapper: Fold) -> Fold:
    """The wrapper with a key for each of its slots, which says where it stands."""
    wrapper.key = hash_of(wrapper.label)
    todo = [wrapper]
    while todo:
        f = todo.pop()
        seen: dict[str, int] = {}
        for k in f.kids:
            seen[k.label] = n = seen.get(k.label, 0) + 1
            k.key = hash_of(f.key, k.label, n)
        todo += f.kids
    return wrapper


def place(page: Fold, wrapper: Fold) -> None:
    """Give the page's nodes their slots: the wrapper's, or a path below one."""
    to = {id(x): y for x, y in match(page, wrapper)}
    todo: list[tuple[Fold, Fold | None]] = [(page, None)]
    while todo:
        f, above = todo.pop()
        if id(f) in to:
            f.key, f.runs = to[id(f)].key, f.runs or to[id(f)].runs
        else:
            f.key = hash_of(above.key if above else 0, f.label, "+")
        todo += [(k, f) for k in f.kids]


class Page:
    """A page's regions, parents first, as (key, parent's number, characters, of these in links, mark, repeats), and its blocks as (region's number, text, key of slot and text, main heading)."""

    def __init__(self, html: str, stable: set[str], wrapper: Fold):
        self.regions: list[list] = []
        self.blocks: list[tuple[int, str, int, bool]] = []
        root = depth_safe(html)
        tree = folded(root, stable)
        place(tree, wrapper)
        folds: list[Fold] = []
        todo: list[tuple[Fold, int]] = [(tree, -1)]
        while todo:
            f, parent = todo.pop()
            f.number = len(self.regions)
            folds.append(f)
            marks = [n.mark() for n in f.nodes]
            self.regions.append([f.key, parent, 0, 0, max(set(marks), key=lambda m: (marks.count(m), m)), f.runs and f.tag not in ITEMS])
            for n in f.nodes:
                n.fold = f
            todo += [(k, f.number) for k in f.kids]
        self.own = [0] * len(folds)  # characters besides links that stand in the region itself
        self.read(root)
        self.tags = ["main" if any(n.role == "main" for n in f.nodes) else f.tag for f in folds]

    def read(self, root: Node) -> None:
        held: list[str] = []
        linked = [0]

        def end(holder: Node) -> None:
            raw = "".join(held)
            held.clear()
            text = " ".join(entities.unescape(raw).split())
            links, linked[0] = min(linked[0], len(text)), 0
            if text:
                n = holder.fold.number
                self.blocks.append((n, text, hash_of(holder.fold.key, text), holder.tag == "h1"))
                self.own[n] += len(text) - links
                while n >= 0:
                    self.regions[n][2] += len(text)
                    self.regions[n][3] += links
                    n = self.regions[n][1]

        stack: list[tuple] = [("in", root, root, False)]
        while stack:
            kind, node, holder, link = stack.pop()
            if kind == "text":
                held.append(node)
                if link:
                    linked[0] += len(" ".join(node.split()))
            elif kind == "out":
                end(holder)
            elif not node.is_text:
                end(holder)
            elif node.tag == "br":
                held.append("\n")
            else:
                link = link or node.tag == "a"
                if node.tag in BLOCKS or node is root:
                    end(holder)
                    holder = node
                    stack.append(("out", node, node, link))
                for c in reversed(node.children):
                    stack.append(("text", c, holder, link) if isinstance(c, str) else ("in", c, holder, link))

    def path(self, n: int) -> list[int]:
        """Numbers of the regions from the root to this one."""
        out = []
        while n >= 0:
            out.append(n)
            n = self.regions[n][1]
        return out[::-1]

    def marks(self) -> list[int]:
        """Marks that count: not those of a part that holds nearly all of the page, unless its element says it."""
        total = self.regions[0][2]
        return [r[4] if r[2] < WRAPS * total or tag in ("nav", "footer", "aside", "header") else 0 for r, tag in zip(self.regions, self.tags)]

    def vote(self) -> int:
        """The deepest region with most of the unmarked text, as its number; an article around it in its place; -1 where there's no such text."""
        marks, mass = self.marks(), [0.0] * len(self.regions)
        total = 0.0
        for n, chars in enumerate(self.own):
            path = self.path(n) if chars else []
            if not chars or any(marks[i] for i in path):
                continue
            weight = chars * (2 if any(self.tags[i] in LANDMARKS for i in path) else 1)
            total += weight
            for i in path if self.tags[n] not in ITEMS or n == 0 else path[:-1]:
                mass[i] += weight
        if not total:
            return -1
        n, best = 0, 0
        while n >= 0:
            best = n
            n = next((k for k in range(n + 1, len(self.regions)) if self.regions[k][1] == n and mass[k] >= VOTE * total), -1)
        return next((i for i in reversed(self.path(best)) if self.tags[i] == "article"), best)


class Host:
    """What a host's pages say: of regions (pages, characters, characters in links, share of repeats), constant texts, votes."""

    def __init__(self, regions: dict[int, tuple[int, int, int, float]], constants: set[int], votes: dict[int, int]):
        self.regions, self.constants, self.votes = regions, constants, votes


def article(page: Page, vote: int, host: Host) -> str:
    """The page's text without the blocks that evidence is against."""
    if vote < 0:
        return ""
    regions, marks = page.regions, page.marks()

    def of(n: int) -> tuple[float, float, float]:
        """(characters on a page, share of links, share of repeats) of a region over the host."""
        pages, chars, links, repeats = host.regions.get(regions[n][0], (1, regions[n][2], regions[n][3], 0.0))
        return chars / pages, links / max(1, chars), repeats

    voted = [n for n in range(len(regions)) if host.votes.get(regions[n][0], 0)] or [vote]
    elected = max(voted, key=lambda n: (host.votes.get(regions[n][0], 0), n == vote, len(page.path(n)), -n))
    above = set(page.path(elected))
    main = of(elected)[0]
    out = []
    for n, text, key, heading in page.blocks:
        path = page.path(n)
        inside = elected in path
        below = [i for i in path if i not in above]
        mark = max((2 if marks[i] == 2 else 0 if marks[i] == 3 and inside else min(marks[i], 1) for i in below), default=0)
        points = 2 * (key in host.constants) + 2 * any(of(i)[1] >= 0.5 for i in below) + mark + (not inside)
        points += (of(below[0])[0] if below else len(text)) < SHORT * main if below or not inside else 0
        points += not inside and of(n)[2] > 0.5
        points += any(regions[i][5] for i in below) and (mark > 0 or not inside)
        points -= not inside and not mark and (heading or any(page.tags[i] in LANDMARKS for i in below))
        if points < AGAINST:
            out.append(text)
    return " ".join(out)


def with_host_table(pages: DataFrame, table: DataFrame, size: str) -> DataFrame:
    """pages with the columns of a table of hosts, of which the column ``size`` tells each row's bytes.

    A table of BROADCAST_BYTES at most goes to all tasks.  A larger one is joined
    on the host and a salt: hosts of more than a thousandth of all pages, which are
    a thousand at most, have as many salts as such parts.
    """
    if (table.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(table.drop(size)), "host", "left")
    part = max(SALT_PAGES, pages.count() // 1000)
    hot = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") > part)
    hot = hot.select("host", F.ceil(F.col("pages") / part).cast("int").alias("salts"))
    hot = written(hot, "hot-hosts")
    keyed = pages.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.col("key"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = table.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", size)
    return keyed.join(spread, ["host", "salt"], "left").drop("salt")


_wrappers: dict[str, tuple[set[str], Fold]] = {}


def wrapper_of(packed: str) -> tuple[set[str], Fold]:
    """A packed wrapper's stable names and tree; a worker keeps those that it has met last."""
    if packed not in _wrappers:
        claim("wrappers", _wrappers.clear)
        if len(_wrappers) >= 200:
            del _wrappers[next(iter(_wrappers))]
        stable, tree = json.loads(packed)
        _wrappers[packed] = (set(stable), keyed(unpacked(tree)))
    return _wrappers[packed]


NO_WRAPPER = json.dumps([[], ["html", "html", False, "", []]])


def wrappers_of(rows: DataFrame) -> DataFrame:
    """(host, wrapper, bytes) of pages (host, key, html): a wrapper from the page of least hash of each of SAMPLES parts."""
    rows = rows.where("html <> ''").withColumn("part", F.pmod("key", F.lit(SAMPLES)))
    least = written(rows.groupBy("host", "part").agg(F.min("key").alias("key")).select("host", "key"), "sampled")
    small = least.count() <= MANY_HOSTS
    chosen = rows.select("host", "key", "html").join(F.broadcast(least) if small else least, ["host", "key"]).groupBy("host", "key").agg(F.min("html").alias("html"))
    samples = chosen.groupBy("host").agg(F.collect_list("html").alias("htmls"))  # SAMPLES at most

    def make():
        return lambda cols: {"host": cols["host"], "wrapper": [induced(x) for x in cols["htmls"]]}

    found = written(map_batches(samples, make, "host string, wrapper string"), "wrappers")
    return found.withColumn("bytes", F.octet_length("wrapper"))


REGIONS = "array<struct<key: long, parent: int, chars: int, links: int, mark: int, runs: boolean>>"
FOUND = f"host string, key long, vote int, regions {REGIONS}, tags array<string>, blocks array<struct<region: int, text: string, key: long, heading: boolean>>"


def described(found: DataFrame) -> DataFrame:
    """(host, what its pages say as arrays, bytes) of found pages; copies of a page count once."""
    parts = F.transform("regions", lambda r: F.struct(r["key"].alias("slot"), r["chars"].alias("chars"), r["links"].alias("links")))
    pieces = F.transform("blocks", lambda b: F.struct(F.get("regions.key", b["region"]).alias("slot"), b["key"].alias("text")))
    page = found.select("host", "key", parts.alias("parts"), F.array_distinct(pieces).alias("pieces"), F.get("regions.key", "vote").alias("chosen"))
    page = written(page.dropDuplicates(["host", "key"]), "distinct-pages")
    sizes = page.groupBy("host").agg(F.count("*").alias("of"))
    sizes = written(sizes, "host-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= MANY_HOSTS else sizes
    some = F.col("n") >= F.greatest(F.lit(2), F.col("of") * RARE)
    regions = page.select("host", F.inline("parts")).groupBy("host", "slot").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    # a text that a page has twice in a slot counts once on it
    texts = page.select("host", F.inline("pieces")).groupBy("host", "slot", "text").agg(F.count("*").alias("m"))
    texts = written(texts, "slot-texts")
    slots = texts.groupBy("host", "slot").agg(F.sum("m").alias("m"), F.count("*").alias("distinct"))
    regions = regions.join(sizes, "host").where(some).join(slots, ["host", "slot"], "left")
    repeats = F.coalesce(1 - F.col("distinct") / F.col("m"), F.lit(0.0))
    regions = regions.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "chars", "links", repeats.alias("repeats"))).alias("slots"))
    constants = texts.where(F.col("m") >= LEAST_PAGES).join(sizes, "host").where(F.col("m") >= SHARE * F.col("of")).groupBy("host").agg(F.collect_list("text").alias("constants"))
    votes = page.where("chosen is not null").groupBy("host", "chosen").agg(F.count("*").alias("n")).join(sizes, "host").where(F.col("n") >= F.col("of") * RARE)
    votes = votes.groupBy("host").agg(F.collect_list(F.struct("chosen", "n")).alias("votes"))
    out = votes.join(regions, "host", "left").join(constants, "host", "left")
    size = 40 * F.greatest(F.size("slots"), F.lit(0)) + 8 * F.greatest(F.size("constants"), F.lit(0)) + 16 * F.size("votes") + F.octet_length("host")
    return written(out.withColumn("bytes", size), "hosts")


def host_of(votes: list | None, slots: list | None, constants: list | None) -> Host:
    return Host({s["slot"]: (s["n"], s["chars"], s["links"], s["repeats"]) for s in slots or ()}, set(constants or ()), {v["chosen"]: v["n"] for v in votes or ()})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    html = text_of(html_col)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), html.alias("html"), F.xxhash64(html).alias("key"))
    with_wrapper = with_host_table(rows, wrappers_of(rows), "bytes").select("page_id", "url", "host", "key", "html", F.coalesce("wrapper", F.lit(NO_WRAPPER)).alias("wrapper"))

    def make():
        def run(cols):
            out = {c: cols[c] for c in ("page_id", "url", "host", "key")} | {c: [] for c in ("vote", "regions", "tags", "blocks")}
            for html, wrapper in zip(cols["html"], cols["wrapper"]):
                page = Page(html, *wrapper_of(wrapper))
                vote = page.vote()
                out["vote"].append(vote)
                out["regions"].append([dict(zip(("key", "parent", "chars", "links", "mark", "runs"), r)) for r in page.regions])
                out["tags"].append(page.tags)
                out["blocks"].append([dict(zip(("region", "text", "key", "heading"), b)) for b in page.blocks])
            return out

        return run

    kind = rows.schema["page_id"].dataType.simpleString()
    found = written(map_batches(with_wrapper, make, f"page_id {kind}, url string, {FOUND}"), "blocks", "zstd")
    judged = with_host_table(found, described(found), "bytes")
    schema = f"page_id {kind}, url string, text string"
    bounded_batches(pages.sparkSession)

    def choose(batches):
        """Rows of one host share its description: it is only read where the host changes."""
        last, host = None, None
        for b in batches:
            t = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            hosts, texts = t["host"].to_pylist(), []
            votes, regions, tags, blocks = (t[c].to_pylist() for c in ("vote", "regions", "tags", "blocks"))
            seen: dict[str, Host] = {last: host} if host else {}
            for i, name in enumerate(hosts):
                if name not in seen:
                    seen[name] = host_of(*(t[c][i].as_py() for c in ("votes", "slots", "constants")))
                texts.append(article(page_from(regions[i], tags[i], blocks[i]), votes[i], seen[name]))
                last, host = name, seen[name]
            yield pa.RecordBatch.from_arrays([t["page_id"], t["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return judged.mapInArrow(choose, schema)


def page_from(regions: list[dict], tags: list[str], blocks: list[dict]) -> Page:
    page = Page.__new__(Page)
    page.regions = [[r[k] for k in ("key", "parent", "chars", "links", "mark", "runs")] for r in regions]
    page.tags = tags
    page.blocks = [(b["region"], b["text"], b["key"], b["heading"]) for b in blocks]
    return page


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
