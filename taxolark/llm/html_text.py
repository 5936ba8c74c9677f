"""Main text of web pages by tree scoring.

A page is parsed into a tree. Each block of running text gives points for its length
and its commas to the container it stands in and, halved at each step, to those
around it; a container's points are discounted by its share of text inside links.
The best container is kept, with the siblings that score well or read like prose.
Boilerplate elements are cut before scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taxolark.llm.tables import pick, slices

#: Fixed values of HTML: elements without an end, with raw text, that are blocks, that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: Scopes: the elements that an element of the scope ends if they were left open, up to the scope's own container.
P_SCOPE = frozenset("p button table td th caption".split())
LEFT_OUT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), **dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th"))}
SCOPE = {"li": "li", "ul": "li", "ol": "li", "menu": "li", "dt": "dl", "dd": "dl", "dl": "dl", "option": "select", "select": "select", **dict.fromkeys("table tr td th tbody thead tfoot".split(), "table")}
#: Never part of an article.
CUT = frozenset("head script style noscript template iframe svg textarea title nav footer aside button select option input label legend dialog menu object embed canvas audio video map area search noembed noframes".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: Words of names that mark boilerplate: a class, or an id outside the article, made up of these and of FILL only.
CUT_WORDS = frozenset(
    "ad ads adbox adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus "
    "dropdown footer gdpr hidden hide login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo "
    "promoted recommended recommendations related reply replies respond search share sharing shoutbox sidebar sidebars signup skyscraper social sponsor sponsored subscribe subscription "
    "toolbar topbar widget widgets alert".split()
)
#: Words that only say more of a part's place, form or number.
FILL = frozenset(
    "area aside bar block body bottom box btn button buttons column columns container content entry group header holder icon icons inner item items left link links list main middle outer page panel "
    "popular post posts primary right row secondary section site slot stories story tertiary thread title top unit wrap wrapper x article articles bars blocks boxes form news".split()
)
#: Headings and table cells: never cut by name. Running text: cut by class alone. Elements whose id may name a part of the page.
FIXED = frozenset("h1 h2 h3 h4 h5 h6 hgroup td th tr tbody thead tfoot caption dt dd".split())
TEXT = frozenset("p pre blockquote figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BY_ID = frozenset("div section ul ol menu dl table center header".split())
#: Labels of links that lead around a site.
LABELS = frozenset("home start about about-us contact contact-us next previous prev back top back-to-top login log-in logout register sign-in sign-up share tweet facebook twitter instagram linkedin youtube pinterest reddit whatsapp email print rss subscribe newsletter privacy privacy-policy imprint impressum terms sitemap search menu help faq jobs careers news blog".split())
GOOD_WORDS = frozenset("article body content entry main page post story text blog hentry".split())
KEEP = frozenset("article main body html".split())
#: Words of a name that reader comments have, wherever they stand; words by which prose inside an article isn't cut.
COMMENTS = frozenset("comment comments commentlist disqus".split())
WEAK = frozenset("widget widgets search respond".split())
#: Share of the page's text from which an element is more than a part of its frame.
MUCH = 1 / 3
#: Prose that makes a form a part of the page's frame: characters, or a share of the page's text with one block as long.
FORM_PROSE, FORM_BLOCK = 400, 80

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_SKIP = re.compile(r"[\s/]*")
_ATTR = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """An element; ``chars`` and ``linked`` are those of the blocks inside it."""

    __slots__ = ("attrs", "chars", "kids", "linked", "score", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, up: Node | None = None):
        self.tag, self.attrs, self.up = tag, attrs or {}, up
        self.kids: list[Node | str] = []
        self.score, self.chars, self.linked = 0.0, 0, 0

    def words(self) -> set[str]:
        """Of its class and id, lower case."""
        return {w.lower() for w in _WORDS.findall(f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}")} if self.attrs else set()

    @property
    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


class _Reader:
    """Reads the attributes of tags, in time in proportion to the page's length."""

    def __init__(self, html: str):
        self.html, self.unclosed = html, {"\"": False, "'": False}

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Of the tag whose name ends at ``at``: attributes, whether it closes itself, the place after it; the page's end if it has none."""
        html, out, n = self.html, {}, len(self.html)
        end = html.find(">", at)
        if end < 0:
            return out, False, n
        if end == at:
            return out, False, end + 1
        while True:
            at = _SKIP.match(html, at).end()
            if at >= n:
                return out, False, n
            if html[at] == ">":
                return out, html[at - 1] == "/", at + 1
            m = _ATTR.match(html, at)
            name, at = m[0].lower(), m.end()
            value, m = "", _EQUALS.match(html, at)
            if m:
                at = m.end()
                mark = html[at : at + 1]
                close = -1
                if mark in self.unclosed and not self.unclosed[mark]:
                    close = html.find(mark, at + 1)
                    self.unclosed[mark] = close < 0
                if close >= 0:
                    value, at = html[at + 1 : close], close + 1
                else:
                    m = _BARE.match(html, at)
                    value, at = m[0], m.end()
            out.setdefault(name, unescape(value) if "&" in value else value)


def parse(html: str) -> Node:
    """A tolerant tree: left-out ends are supplied, stray ends ignored, raw text kept whole.

    A tag without an end takes the rest of the page, as in browsers. Every open element
    is closed once, and what a tag may close is looked up in its scope, so the time
    is in proportion to the page's length however deep it nests.
    """
    root = here = Node("html")
    reader, at, n = _Reader(html), 0, len(html)
    count: dict[str, int] = {}  # open elements by tag
    open_p: list[Node] = []  # of P_SCOPE, innermost last
    scopes: dict[str, list[Node]] = {"li": [], "dl": [], "select": [], "table": []}
    endless: set[str] = set()  # raw text elements that no end follows any more

    def close(node: Node) -> None:
        """Closes an open element and all inside it."""
        nonlocal here
        while True:
            last, here = here, here.up
            count[last.tag] -= 1
            if open_p and open_p[-1] is last:
                open_p.pop()
            scope = scopes.get(SCOPE.get(last.tag, ""))
            if scope and scope[-1] is last:
                scope.pop()
            if last is node:
                return

    def add(text: str) -> None:
        if text:
            here.kids.append(unescape(text) if "&" in text else text)

    while at < n:
        mark = html.find("<", at)
        while 0 <= mark and (following := html[mark + 1 : mark + 2]) not in ("!", "?") and not _NAME.match(html, mark + 1):
            mark = html.find("<", mark + 1)
        if mark < 0:
            add(html[at:])
            break
        add(html[at:mark])
        if following in ("!", "?"):
            comment = html.startswith("<!--", mark)
            end = html.find("-->", mark + 4) if comment and not html.startswith(">", mark + 4) else html.find(">", mark)
            at = n if end < 0 else end + (3 if html.startswith("-->", end) else 1)
            continue
        m = _NAME.match(html, mark + 1)
        tag = m[0].lower()
        attrs, closed, at = reader.attributes(m.end())
        if tag[0] == "/":
            tag = tag[1:]
            if count.get(tag):
                node = here
                while node.tag != tag:
                    node = node.up
                close(node)
            elif tag == "br":
                here.kids.append(Node("br", up=here))
            continue
        if tag in ENDS_P and open_p and open_p[-1].tag == "p":
            close(open_p[-1])
        if tag in LEFT_OUT:
            scope, ends, outer = scopes[SCOPE[tag]], LEFT_OUT[tag], None
            for node in reversed(scope):
                if node.tag not in ends:
                    break
                outer = node
            if outer is not None:
                close(outer)
        if tag == "html" and here is root:
            continue
        node = Node(tag, attrs, here)
        here.kids.append(node)
        if tag in RAW:
            if tag == "svg" and closed:
                continue
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if end:
                at = reader.attributes(end.end())[2]
            elif tag == "svg":
                endless.add(tag)
            else:
                at = n
        elif tag not in VOID and not closed:
            here = node
            count[tag] = count.get(tag, 0) + 1
            if tag in P_SCOPE:
                open_p.append(node)
            if tag in SCOPE:
                scopes[SCOPE[tag]].append(node)
    return root


def _marks(name: str) -> bool:
    """Whether a whole name says boilerplate: not if it has words of any other kind."""
    words = {w.lower() for w in _WORDS.findall(name)}
    return bool(words & CUT_WORDS) and all(w in CUT_WORDS or w in FILL or w.isdigit() for w in words)


def _mostly(name: str) -> bool:
    """Whether at most a third of a name's words are of another kind."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return bool(CUT_WORDS & {*words}) and 3 * sum(w in CUT_WORDS or w in FILL or w.isdigit() for w in words) >= 2 * len(words)


class _Links:
    """Of elements, how much text they hold and how much of it in links; the whole tree is summed up at the first question."""

    def __init__(self, root: Node):
        self.root, self.sums = root, None

    def prose(self, node: Node) -> bool:
        """Whether less than a third of the text is in links."""
        chars, linked = self.counted(node)
        return 3 * linked < chars

    def little(self, node: Node) -> bool:
        """Whether an element holds no more than a frame's part does of the page's text."""
        return self.counted(node)[0] < MUCH * self.counted(self.root)[0]

    def counted(self, node: Node) -> list[int]:
        if self.sums is None:
            order, todo, self.sums = [], [(self.root, False)], {}
            while todo:
                x, link = todo.pop()
                link = link or x.tag == "a"
                own = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
                self.sums[id(x)] = [own, own * link]
                order.append(x)
                todo += [(k, link) for k in x.kids if isinstance(k, Node)]
            for x in reversed(order):
                if x.up is not None and x is not self.root:
                    for n in range(2):
                        self.sums[id(x.up)][n] += self.sums[id(x)][n]
        return self.sums[id(node)]


def boilerplate(node: Node, inside: bool, links: _Links) -> bool:
    """Whether an element is cut before scoring; ``inside``: it stands in an article or in the main part."""
    if node.tag in CUT:
        return True
    attrs = node.attrs
    if not attrs:
        return node.tag == "header" and not inside
    if attrs.get("role", "").lower() in CUT_ROLES and not (node.tag == "form" and attrs["role"].lower() == "form"):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    words = node.words()
    if (node.tag == "header" or words in ({"header"}, {"site", "header"}, {"page", "header"}, {"top", "header"})) and not inside:
        return True
    if not words & CUT_WORDS or node.tag in FIXED:
        return False
    names = [*attrs.get("class", "").split(), attrs.get("id", "")]
    if node.tag not in ("main", "body", "html") and any(_marks(x) and {w.lower() for w in _WORDS.findall(x)} & COMMENTS for x in names) and (node.tag not in ("li", "ol", "ul") or attrs.get("class")):
        return True
    if node.tag in KEEP or (words & {"article", "content", "story", "main"} and not words & {"ad", "ads", "advert", "comment", "comments", "sidebar", "related", "share", "social"}):
        return False
    if node.tag in TEXT:
        return any(_marks(name) for name in names[:-1])
    if any(_mostly(name) for name in names[:-1]) and links.little(node):
        return not (inside and not words & (CUT_WORDS - WEAK) and links.prose(node))
    if any(_marks(name) for name in names[:-1]):
        # inside an article prose may bear such a name as well
        return not (inside and not words & (CUT_WORDS - WEAK) and links.prose(node))
    # inside an article an id is mostly made of a heading's words
    return node.tag in BY_ID and _marks(names[-1]) and not inside


def prune(root: Node) -> list[Node]:
    """Takes boilerplate out; the elements left, each before those inside it."""
    left, forms, todo, links = [], [], [(root, False)], _Links(root)
    while todo:
        node, inside = todo.pop()
        left.append(node)
        inside = inside or node.tag in ("article", "main") or node.attrs.get("role", "").lower() in ("main", "article")
        kids: list[Node | str] = []
        for kid in node.kids:
            if isinstance(kid, str) or not boilerplate(kid, inside, links):
                kids.append(kid)
        node.kids = kids
        todo += [(k, inside) for k in reversed(kids) if isinstance(k, Node)]
        if node.tag == "form":
            forms.append(node)
    return _without_forms(root, left, forms) if forms else left


def _without_forms(root: Node, left: list[Node], forms: list[Node]) -> list[Node]:
    """Takes out forms but those that hold the page's prose, as whole pages may stand in one."""
    found = blocks(root)
    add_up(left, found)
    holds: dict[int, list[int]] = {}  # of each form: characters outside links, the longest block, whether it has an article or a title
    within: dict[int, Node | None] = {}
    for node in left:
        within[id(node)] = node if node.tag == "form" else within.get(id(node.up)) if node.up is not None else None
        form = within[id(node)]
        if form is not None and node.tag in ("article", "main", "h1"):
            holds.setdefault(id(form), [0, 0])[0] = FORM_PROSE
    for b in found:
        form = within[id(b.node)]
        if form is not None:
            own = holds.setdefault(id(form), [0, 0])
            own[0] += len(b.text) - b.linked
            own[1] = max(own[1], len(b.text) - b.linked)
    for form in forms:
        prose, longest = holds.get(id(form), [0, 0])
        if not (prose >= FORM_PROSE or (longest >= FORM_BLOCK and 2 * prose >= root.chars - root.linked)):
            form.kids = []
    for node in left:
        node.chars = node.linked = 0
    return left


def navigation(node: Node) -> bool:
    """Whether a list of links leads around a site: most of its links bear the labels of such."""
    labels, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag == "a":
            parts, inner = [], [n]
            while inner:
                x = inner.pop()
                if isinstance(x, str):
                    parts.append(x)
                else:
                    inner += reversed(x.kids)
            labels.append("-".join(re.findall(r"\w+", "".join(parts).lower())))
        else:
            todo += [k for k in n.kids if isinstance(k, Node)]
    labels = [x for x in labels if x]
    return len(labels) > 1 and 3 * sum(x in LABELS for x in labels) >= 2 * len(labels)


def _first_text(node: Node) -> tuple[Node, str]:
    """The first text inside an element, and the element that it stands in."""
    todo: list[tuple[Node, Node | str]] = [(node, k) for k in reversed(node.kids)]
    while todo:
        up, x = todo.pop()
        if not isinstance(x, str):
            todo += [(x, k) for k in reversed(x.kids)]
        elif x.strip():
            return up, x.strip()
    return node, ""


def thread(node: Node) -> bool:
    """Whether an element holds a row of parts that are built alike and begin with a short line, such as a name: what readers wrote.

    Parts that begin with a heading or a bold term are sections, and parts of one block are paragraphs.
    """
    if node.tag not in ("div", "section", "ul", "ol"):
        return False
    parts = [k for k in node.kids if isinstance(k, Node) and k.chars]
    if len(parts) < 2 or not parts[-1].attrs.get("class") or len({(k.tag, k.attrs.get("class")) for k in parts[-2:]}) > 1:
        return False
    alike = [k for k in parts if (k.tag, k.attrs.get("class")) == (parts[-1].tag, parts[-1].attrs["class"])]
    if len(alike) < len(parts) - 1:  # a heading may stand before them
        return False
    for k in alike:
        up, text = _first_text(k)
        first = next((x for x in k.kids if (x.strip() if isinstance(x, str) else _first_text(x)[1])), None)
        told = any(isinstance(x, Node) and x is not first and x.tag in BLOCK and x.chars for x in k.kids)
        if not told or len(text) > 40 or text[-1] in ".!?" or up.tag in HEADINGS or up.tag in ("b", "strong"):
            return False
    return True


class Block:
    """One run of text between block borders, its container, and its characters inside links."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def blocks(root: Node) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    owner = root

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(owner, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    # an explicit stack: pages may nest deeper than Python calls may
    todo: list[tuple[Node, int, Node, int]] = [(root, 0, root, 0)]
    while todo:
        node, at, container, links = todo.pop()
        owner = container
        if at == len(node.kids):
            if node.tag in BLOCK:
                close()
            continue
        todo.append((node, at + 1, container, links))
        kid = node.kids[at]
        if isinstance(kid, str):
            parts.append(kid)
            if links:
                linked += len(_SPACE.sub(" ", kid).strip())
            continue
        if kid.tag == "br":
            parts.append(" ")
        elif kid.tag in BLOCK:
            close()
        todo.append((kid, 0, kid if kid.tag in BLOCK else container, links + (kid.tag == "a")))
    return out


def add_up(nodes: list[Node], found: list[Block]) -> None:
    """Gives each element the characters of all blocks inside it."""
    for b in found:
        b.node.chars += len(b.text)
        b.node.linked += b.linked
    for node in reversed(nodes):  # elements come before those inside them
        if node.up is not None:
            node.up.chars += node.chars
            node.up.linked += node.linked


def _within(node: Node, other: Node) -> bool:
    """Whether a node is another one or stands inside it."""
    up: Node | None = node
    while up is not None and up is not other:
        up = up.up
    return up is other


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    nodes = prune(root)
    found = blocks(root)
    if not found:
        return ""
    add_up(nodes, found)
    for b in found:
        if len(b.text) < 25:
            continue
        points = 1 + b.text.count(",") + b.text.count("、") + min(3, len(b.text) / 100)
        up: Node | None = b.node.up if b.node.tag in ("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3", "h4") and b.node.up is not None else b.node
        share = 1.0
        while up is not None and share > 0.1:
            up.score += points * share
            share /= 2
            up = up.up

    def value(node: Node) -> float:
        bonus = 25 * (node.tag in ("article", "main")) + 15 * bool(node.words() & GOOD_WORDS)
        return (node.score + bonus * (node.score > 0)) * (1 - node.density)

    best = max((x for x in nodes if x.chars), key=value)
    homes = [x for x in nodes if x.chars and (x.tag in ("article", "main") or x.attrs.get("role", "").lower() == "main")]
    if value(best) <= 0 or homes:
        # an article of short blocks, or one that the best container only surrounds
        around = {id(best)}
        for x in nodes:
            if x.up is not None and id(x.up) in around:
                around.add(id(x))
        weak = value(best) < 10  # what a block or two score
        inner = [x for x in homes if x is not best and (value(best) <= 0 or (id(x) in around and 2 * x.chars >= best.chars) or (weak and x.chars >= best.chars and not _within(best, x)))]
        best = max(inner, key=lambda x: x.chars, default=best)
    if value(best) <= 0 and best.tag not in ("article", "main") and best not in homes:
        # only short blocks: all text that isn't links
        return "\n\n".join(b.text for b in found if b.linked * 2 <= len(b.text))
    kept = {id(best)}
    least = max(10.0, value(best) * 0.2)
    if best.tag == "article" and best.up is not None:  # articles side by side
        kept |= {id(k) for k in best.up.kids if isinstance(k, Node) and k.tag == "article" and k.chars and k.density < 0.25 and value(k) >= least}
    elif best.up is not None and best.tag not in ("main", "body"):
        framed = best.up.tag not in ("body", "html")  # inside a container of their own, siblings need not be long
        short = {id(b.node): b.text for b in found if _RIGHTS.search(b.text) and len(b.text) < 200} if framed else {}
        rights = {id(x) for n in nodes if id(n) in short for x in (n, n.up)}
        for kid in best.up.kids:
            if isinstance(kid, Node) and kid is not best and kid.chars and not thread(kid):
                prose = kid.density < 0.25 and (kid.chars > 80 or (framed and id(kid) not in rights))
                title = kid.tag in ("h1", "h2", "h3", "hgroup", "header")
                if value(kid) >= least or (prose and kid.tag in ("p", "pre", "blockquote", "ul", "ol", "dl", "div", "section", "table", "figure")) or title:
                    kept.add(id(kid))
        # farther up, what scores like the article
        at = best.up
        while framed and at.up is not None and at.tag not in ("article", "main", "body", "html"):
            for kid in at.up.kids:
                if isinstance(kid, Node) and kid is not at and kid.chars and kid.density < 0.25 and value(kid) >= 0.2 * value(best) and not thread(kid):
                    kept.add(id(kid))
            at = at.up
    # of each kept element the kept part of the page, and the links' list, that it stands in
    part: dict[int, Node | None] = {}
    menu: dict[int, bool] = {}
    body = sum(x.chars for x in nodes if id(x) in kept)
    for node in nodes:
        up = node.up
        inside = up is not None and part[id(up)] is not None
        part[id(node)] = node if inside or id(node) in kept else None
        menu[id(node)] = inside and (menu[id(up)] or (node.tag in ("ul", "ol", "table", "dl") and node.density > 0.6 and navigation(node)) or (2 * node.chars < body and thread(node)))
    return "\n\n".join(b.text for b in found if part[id(b.node)] is not None and not menu[id(b.node)])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html), one row for each row.

    White space inside a block becomes one space and blocks are joined by an empty
    line in page order. A null or empty html, and a page without running text, give
    an empty text. Null page_ids and urls are returned as they are; repeated rows stay;
    other columns are ignored; no rows give no rows.
    """
    rows = pick(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())]))
