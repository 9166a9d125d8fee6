"""Main text of web pages by tree scoring.

The markup is read into a small tree (unclosed paragraphs and list items are closed as browsers do). Blocks with text
of their own pass points to their parent and, halved, to their grandparent: one for being there, one for each comma,
up to three for length. A container's points are discounted by its link density. The best container and those of its
siblings that score like it or hold paragraphs, lists, tables or headings that are not mostly links are kept (beside an
article or main element only those that score like it or are long), and with an article all others of the page.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever
they stand. They are told by their elements; by the words of their class, id and role names, in whatever combination,
unless these say what a container has or lacks; by a heading that announces them; and, as the standard has it for
comments, by articles inside articles. What is told by a name alone is taken back if it has the article's heading and
most of the text, or if the page has no paragraph besides.

Defined cases: a null or empty page has an empty text; text outside of all elements counts as the body's; character
references are decoded once; unknown and unclosed elements are taken as they come; a page whose text is all in
boilerplate has an empty text; repeated pages are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object audio video canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
#: What a start tag closes if it is the current block: itself, or what cannot hold it.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Elements, and words of class, id or role names, of what is not main text.
LEFT_OUT = frozenset("nav header footer aside form button select option dialog menu head fieldset label".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense adslot adunit banner banners sponsor sponsors sponsored promo promos "
    "promoted promotion promotions sidebar nav navbar navigation menu menus breadcrumb breadcrumbs comment comments commenters disqus reply replies "
    "respond cookie cookies consent gdpr notice notices popup modal overlay lightbox subscribe subscription newsletter newsletters signup share shares "
    "sharing social related recommended recommendation recommendations trending widget widgets pagination pager skip toolbar topbar masthead alert "
    "alerts announcement announcements disclaimer disclaimers paywall teaser teasers".split()
)
#: Two words that together are such a mark.
PAIRS = frozenset({
    ("most", "read"), ("most", "viewed"), ("most", "popular"), ("most", "shared"), ("read", "next"), ("read", "more"), ("more", "from"), ("more", "stories"),
    ("also", "like"), ("side", "bar"), ("sign", "up"), ("log", "in"), ("call", "action"),
})
#: Words that are a mark only where the rest of the name places it.
PLACED = frozenset("header footer foot head".split())
#: Marks of readers' comments: what has them is never taken back for want of other text.
READERS = frozenset("comment comments commenters disqus reply replies respond".split())
#: Words of names that say what a container has, lacks or is filed under.
STATES = frozenset("has have no non not without with hide is are category tag type format status".split())
#: Headings of parts that are not main text.
ANNOUNCES = re.compile(
    r"(?:\d+ )?(?:(?:reader |user |readers' )?comments?|responses?|replies|leave a (?:comment|reply)|join the (?:conversation|discussion)|related(?: \w+)?|"
    r"recommended(?: \w+)*|you (?:may|might) also like(?: this)?|read (?:more|next)|more (?:from|stories)(?: [\w ]+)?|most (?:read|popular|viewed|shared)(?: \w+)?|"
    r"share(?: this)?(?: \w+)?|follow us(?: on \w+)?|advertisements?|sponsored(?: \w+)?|subscribe(?: [\w ]+)?|(?:our )?newsletters?|sign up(?: [\w ]+)?|"
    r"trending(?: \w+)?|popular (?:posts|articles|stories))(?: ?\(\d+\))?:?",
    re.I,
)
#: Where a start or end tag may close, or a quoted value begins.
_MARK = re.compile(r"""=[ \t\r\n\f]*(["'])|>""")
_TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/<>]*")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
#: Parts that hold text of their own kind beside paragraphs.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = HEADINGS | frozenset("p ul ol dl table pre blockquote figure".split())


#: Words that only place or shape what the other words of a name say.
PLACING = frozenset("site page main global top bottom left right primary secondary wrapper wrap container inner box area list block section bar links item".split())
#: How sure it is that an element is not main text: by a name with other words in it, by a name, or whatever it holds.
BY_PART, BY_NAME, ALWAYS = 1, 2, 3
#: Characters from which on a block outside of links is a paragraph.
PARAGRAPH = 25


class Node:
    __slots__ = ("tag", "parent", "block", "parts", "out", "points", "size", "linked", "own")

    def __init__(self, tag: str, parent: Node | None, out: int):
        self.tag, self.parent, self.out = tag, parent, out
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block  # the nearest block, itself included
        self.parts: list = []  # texts and nodes in page order
        self.points, self.size, self.linked, self.own = 0.0, 0, 0, 0


def _left_out(tag: str, attributes: str) -> int:
    if tag in LEFT_OUT:
        return ALWAYS
    if not attributes or tag in ("html", "body", "main"):
        return 0
    if _hidden(attributes):
        return ALWAYS
    names = " ".join(x for m in _NAMES.findall(attributes) for x in m).split()
    return max(map(_mark, names), default=0)


def _mark(name: str) -> int:
    """Whether a class, id or role name is one of boilerplate: a mark in any of its words, unless it says what is there."""
    words = [w for w in re.split(r"[^a-z]+", _HUMP.sub("-", name).lower()) if w]
    found = [w for w in words if w in MARKS]
    placed = PLACED.intersection(words)
    rest = set(words) - MARKS - PLACED - PLACING
    if not STATES.isdisjoint(words):
        return 0
    if not READERS.isdisjoint(words) or (found or placed) and not rest:
        return BY_NAME
    return BY_PART if found or any(p in PAIRS for p in itertools.pairwise(words)) else 0


def _text_of(node: Node, most: int = 80) -> str:
    """The beginning of a node's text."""
    parts, stack, size = [], [node], 0
    while stack and size < most:
        x = stack.pop()
        if type(x) is str:
            parts.append(x)
            size += len(x)
        else:
            stack += reversed(x.parts)
    return " ".join(html.unescape("".join(parts)).split())


def _announced(nodes: list[Node]) -> None:
    """Leaves out what a heading announces as boilerplate: its container, if it stands first there, or else what follows it
    up to the next heading of its rank."""
    for head in nodes:
        if head.tag not in HEADINGS or head.out or head.parent is None or not ANNOUNCES.fullmatch(_text_of(head)):
            continue
        beside = head.parent.parts
        at = next(i for i, p in enumerate(beside) if p is head)
        alone = not any(p.strip() if type(p) is str else p.tag not in VOID for p in beside[:at])
        if alone and head.parent.tag in ("div", "section", "li", "ul", "ol"):
            head.parent.out = max(head.parent.out, BY_NAME)
            continue
        for p in beside[at:]:
            if type(p) is not Node:
                continue
            if p is not head and p.tag in HEADINGS and p.tag <= head.tag:
                break
            p.out = max(p.out, BY_NAME)


def _decide(root: Node) -> None:
    """Leaves out what headings and nesting tell, and takes back what only a name told."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [p for p in node.parts if type(p) is Node and p.out != ALWAYS]
    _announced(nodes)
    size, heads, inside = {}, {}, {}
    for n in reversed(nodes):
        below = [p for p in n.parts if type(p) is Node and id(p) in size]
        size[id(n)] = sum(len(p.strip()) for p in n.parts if type(p) is str) + sum(size[id(p)] for p in below)
        heads[id(n)] = n.tag in ("main", "h1") or n.tag == "article" and not n.out or any(heads[id(p)] for p in below)
    for n in nodes:  # an article inside an article is a reader's comment, unless it is most of it
        outer = inside.get(id(n.parent)) if n.parent is not None else None
        if n.tag == "article" and outer is not None and 2 * size[id(n)] <= size[id(outer)]:
            n.out = max(n.out, BY_NAME)
        inside[id(n)] = n if n.tag == "article" else outer
    for n in nodes:
        if n.out and heads[id(n)] and 2 * size[id(n)] > size[id(root)]:
            n.out = 0
    stack, parts, other = [root], [], 0
    while stack:
        n = stack.pop()
        if n.out == BY_PART:
            parts.append(n)
        elif not n.out and n.tag != "a":
            other = max(other, sum(len(p.strip()) for p in n.parts if type(p) is str))
            stack += [p for p in n.parts if type(p) is Node]
    if other < PARAGRAPH:
        for n in parts:
            n.out = 0


def _hidden(attributes: str) -> bool:
    for name, *value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(value)
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


class _Tokens:
    """Texts and tags of a page in one pass: ``(name, attributes, text)``; end tags have a name that begins with ``/``.

    Time is linear in the page, however broken it is: what was once sought in vain is not sought again.
    """

    def __init__(self, page: str):
        self.page = page
        self.dead: set[int] = set()  # marks from which no end of a tag follows
        self.missing: set[str] = set()  # quotes and ends that don't occur any more
        self.since, self.mark = -1, None  # the last search for a mark: from where, and what it found

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.missing else self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag; quoted values may hold others; -1 without one."""
        seen = []
        while (m := self.next_mark(at)) and m.start() not in self.dead:
            if m[1] is None:
                return m.start()
            seen.append(m.start())
            close = self.find(m[1], m.end())
            at = m.end() if close < 0 else close + 1
        self.dead.update(seen)
        return -1

    def next_mark(self, at: int) -> re.Match | None:
        if not (0 <= self.since <= at and (self.mark is None or at <= self.mark.start())):
            self.since, self.mark = at, _MARK.search(self.page, at)
        return self.mark

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            if page[at] != "<":
                stop = page.find("<", at)
                stop = end if stop < 0 else stop
                yield "", "", page[at:stop]
                at = stop
                continue
            if page.startswith("<!--", at):
                stop = self.find("-->", at + 4)
                at = end if stop < 0 else stop + 3
                continue
            if page.startswith(("<!", "<?"), at):
                stop = self.find(">", at)
                at = end if stop < 0 else stop + 1
                continue
            name = _TAG_NAME.match(page, at + 1)
            stop = self.tag_end(name.end()) if name else -1
            if name and stop < 0:  # quotes that never end: the first > ends the tag
                stop = self.find(">", name.end())
            if stop < 0:
                yield "", "", "<"
                at += 1
                continue
            yield name[0].lower(), page[name.end() : stop], ""
            at = stop + 1
            tag = name[0].lower()
            if tag in RAW and page[stop - 1] != "/":
                at = self.skip(tag, at)

    def skip(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup; without one only scripts and styles go on to the end."""
        what = f"</{tag}"
        close = None if what in self.missing else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if close:
            return close.end()
        self.missing.add(what)
        return len(self.page) if tag in ("script", "style") else at


def parse(page: str) -> Node:
    root = at = Node("body", None, 0)
    open_: dict[str, int] = {}  # how many elements of a name are open

    def close_to(node: Node) -> None:
        nonlocal at
        while at is not node:
            open_[at.tag] -= 1
            at = at.parent

    for tag, attributes, text in _Tokens(page):
        if not tag:
            at.parts.append(text)
        elif tag[0] == "/":
            if open_.get(tag[1:]):
                node = at
                while node.tag != tag[1:]:
                    node = node.parent
                close_to(node.parent)
        elif tag in VOID:
            at.parts.append(Node(tag, at, 0))
        elif tag not in RAW and tag not in ("html", "body"):
            if tag in BLOCKS or tag in CLOSES:
                shut = CLOSES.get(tag, {"p"})
                while at.block.tag in shut and at.block.parent is not None:
                    close_to(at.block.parent)
            node = Node(tag, at, _left_out(tag, attributes))
            at.parts.append(node)
            open_[tag] = open_.get(tag, 0) + 1
            at = node
    return root


def _order(root: Node) -> list[Node]:
    """All nodes that are not left out, parents first."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [p for p in reversed(node.parts) if type(p) is Node and not p.out]
    return nodes


def score(nodes: list[Node]) -> None:
    for node in nodes:
        texts = [p for p in node.parts if type(p) is str]
        node.own = node.size = sum(len(t.strip()) for t in texts)
        node.linked = node.size if node.tag == "a" else 0
        block = node.block
        if node.size:
            points = 1 + sum(t.count(",") for t in texts) + min(3, node.size // 100)
            holder = block.parent if block.tag not in ("article", "main", "section", "div", "body") and block.parent is not None else block
            holder.points += points
            if holder.parent is not None:
                holder.parent.points += points / 2
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.size if node.parent.tag == "a" else node.linked


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _decide(root)
    nodes = _order(root)
    score(nodes)
    final = {id(n): n.points * (1 - _density(n)) for n in nodes}
    best = max(nodes, key=lambda n: final[id(n)])  # the first of equals, nearest to the root
    if final[id(best)] <= 0:
        best = root
    node = best
    while node is not None:  # the whole article, with its heading
        if node.tag in ("article", "main"):
            best = node
            break
        node = node.parent
    top = Node("body", None, 0)
    if best.parent is None:
        top.parts = [best]
    else:
        kept = {id(p) for p in best.parent.parts if type(p) is Node and _kept(p, best, final)}
        loose = best.parent if best.tag not in ("article", "main") else None  # texts beside the best container count
        if best.tag in ("article", "main"):
            kept |= {id(n) for n in nodes if n.tag in ("article", "main") and n.size and _density(n) < 0.25}
        stack: list = [root]
        while stack:  # in page order; what is kept is taken as a whole
            x = stack.pop()
            if type(x) is str or id(x) in kept:
                top.parts += [x, " "] if type(x) is str else [x]
            elif not x.out:
                stack += [p for p in reversed(x.parts) if type(p) is Node or x is loose]
    blocks: list[str] = []
    _collect(top, blocks)
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _kept(p: Node, best: Node, final: dict[int, float]) -> bool:
    """Whether a part beside the best container belongs to the text."""
    whole = best.tag in ("article", "main")
    if p is best or p.out:
        return p is best
    if whole:
        return final[id(p)] >= max(10.0, 0.2 * final[id(best)]) or (
            p.tag in ("p", "h1", "h2", "pre", "blockquote") and (_density(p) < 0.25 and p.size > 80 or p.tag in ("h1", "h2") and best.tag != "article")
        )
    if p.tag in ("h1", "h2") or final[id(p)] >= 0.2 * final[id(best)] > 0:
        return True
    # Lists, tables, headings, paragraphs and what holds such; runs of links are menus.
    return _density(p) < 0.25 and (p.tag not in BLOCKS or any(n.tag in CONTENT for n in _order(p)))


def _collect(top: Node, blocks: list[str]) -> None:
    """Texts of the blocks below a node in page order, character references decoded."""
    current: list[str] = []

    def flush() -> None:
        if current:
            blocks.append(html.unescape("".join(current)))
            current.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif type(x) is str:
            current.append(x)
        elif not x.out:
            if x.tag == "br":
                current.append(" ")
            elif x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(x.parts)
    flush()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_text": op8_html_text}
