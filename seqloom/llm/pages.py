"""Main text of web pages by composite text density.

A page becomes a small tree. Every node has its characters per tag, lowered where links make up much of
the text; the node whose children's densities sum highest is the article, and the least density on the path
from the body to it is the threshold at which further parts of the page belong to it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import kernels as K

#: Names from the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of a kind ends, up to the scope that holds it.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
ENDS_P = BLOCK - {"body", "html", "br", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
P_SCOPE = frozenset("td th table button caption article section div body html".split())

#: What is never part of an article: controls and the like always, the others by element, by role and by the
#: words of class and id unless the article stands in them (see ``judge``).
DROPPED = RAW | frozenset("button select input head canvas audio video label".split())
MARKED = frozenset("nav aside footer form menu dialog fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner sidebar side widget menu nav navbar navigation "
    "breadcrumb breadcrumbs footer foot masthead topbar comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toc copyright legal disclaimer".split()
)
#: Of these words a longer name may speak without being such a box (content-sidebar-wrap), and these are of other texts.
LAYOUT_WORDS = frozenset(
    "ad ads sidebar side widget menu nav navbar navigation banner header footer foot masthead topbar breadcrumb breadcrumbs "
    "overlay modal popup toc share sharing social notice notices alert".split()
)
OTHER_TEXTS = frozenset("comment comments commentlist disqus respond replies reply related recommended".split())
BOX_WORDS = DROPPED_WORDS | {"header"}
#: Marks of an element that may well be around a whole page.
AROUND = frozenset({("<form>",), ("<fieldset>",), ("role", "form")})
#: A name is taken back if this many times the other unlinked text stands under it; a plain one if hardly any other is left.
MOST, ALL, LITTLE = 3, 20, 200
#: What can stand in a head; anything else ends it.
IN_HEAD = frozenset("title meta link style script noscript base template".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: First words of names that speak of what a box has around it, and words of an article's own head.
SAID_OF = frozenset("has no with without is".split())
ARTICLE_WORDS = frozenset("article post entry story content text".split())
KEPT_HEADER = frozenset({"article", "main"})
#: Words that a box's name has beside the word for what it is (comments-area, sidebar-right): they say nothing of an article's subject.
OF_BOXES = frozenset(
    "area box wrap wrapper container list section block bar left right top bottom main inner outer content post article page site item items link links "
    "button buttons btn form title header head body row col column group panel card region zone slot unit space holder module component element "
    "primary secondary global local sticky fixed floating desktop mobile js wp the a of and to in for my all more this us".split()
)
#: Unlinked characters from which on a box of a doubtful name in an article is text of it.
DOUBTFUL = 120
#: Text in these does not end the run of menus at an edge of the article.
NO_EDGE = frozenset("a h1 h2 h3 h4 h5 h6".split())

#: A tag's name; longer ones are of no known element.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,63})")
SPECIAL = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
WORD = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("name", "children", "dropped", "marks", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, name: str, dropped: bool = False, marks: tuple[tuple[str, ...], ...] = ()):
        self.name, self.dropped, self.marks = name, dropped, marks
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _marks(name: str, attributes: str, in_article: bool) -> tuple[tuple[str, ...], ...]:
    """Why an element looks like no part of an article: its element, its role, and names in words."""
    out = []
    if name in MARKED:
        out.append((f"<{name}>",))
    if name == "header":
        return () if in_article else (("<header>",),)
    if not attributes or name in ("body", "html", "article", "main"):
        return tuple(out)
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            out.append(("hidden",))
        if key == "role" and value.lower() in DROPPED_ROLES:
            out.append(("role", value.lower()))
        if key in ("class", "id"):
            for name_ in value.split():
                words = tuple(w.lower() for w in WORD.findall(CAMEL.sub(" ", name_)))
                if not words or words[0] in SAID_OF:
                    continue
                if not DROPPED_WORDS.isdisjoint(words):
                    out.append(words)
                elif "header" in words and ARTICLE_WORDS.isdisjoint(words) and not in_article:
                    out.append(words)
    return tuple(dict.fromkeys(out))


def _speaks_of(mark: tuple[str, ...]) -> bool:
    """A mark that a box around an article may have."""
    boxes = BOX_WORDS.intersection(mark)
    return mark in AROUND or (bool(boxes) and boxes <= LAYOUT_WORDS and len(boxes) < len(set(mark)))


def _doubtful(mark: tuple[str, ...]) -> bool:
    """A name that may as well speak of an article's subject: side-effects, share-price, comment-policy."""
    return not mark[0].startswith("<") and mark[0] not in ("role", "hidden") and not OF_BOXES.issuperset(set(mark) - BOX_WORDS)


def judge(root: Node) -> None:
    """Decides on the marked elements: those are dropped that the article does not stand in.

    Marks are taken back from the elements around a ``main``; around an ``article`` with more unlinked text than
    is left otherwise, where none is left; and, for all elements of that name (and of longer names that
    begin with it), where most of the unlinked text stands under the name. Elements within are judged likewise.
    Names of other texts, as comments, only give way to a ``main``. In an ``article`` or ``main`` a box stays that holds
    some text and whose name may be of the article's subject.
    """
    order, stack = [], [(root, None, False)]
    inside: dict[int, bool] = {}
    while stack:
        node, parent, linked = stack.pop()
        order.append((node, parent, linked))
        inside[id(node)] = parent is not None and (inside[id(parent)] or parent.name in KEPT_HEADER)
        stack += [(x, node, linked or x.name == "a") for x in node.children if isinstance(x, Node) and not x.dropped]
    if not any(node.marks for node, _, _ in order):
        return
    plain: dict[int, int] = {}
    article: dict[int, int] = {}
    around: set[int] = set()
    for node, parent, linked in reversed(order):
        me = id(node)
        plain[me] = plain.get(me, 0) + (0 if linked else sum(len(x.strip()) for x in node.children if isinstance(x, str)))
        if node.name == "article":
            article[me] = max(article.get(me, 0), plain[me])
        if ("hidden",) in node.marks:
            around.discard(me)
        if parent is not None:
            up = id(parent)
            plain[up] = plain.get(up, 0) + plain[me]
            if me in article:
                article[up] = max(article.get(up, 0), article[me])
            if node.name == "main" or me in around:
                around.add(up)

    left, stated = 0, False
    excused: set[tuple[str, ...]] = set()
    edge: dict[int, Node] = {}
    under: dict[tuple[str, ...], dict[int, Node]] = {}
    amount: dict[tuple[str, ...], int] = {}

    def live(node: Node) -> bool:
        for mark in node.marks:
            if not any(mark[:k] in excused and BOX_WORDS.isdisjoint(mark[k:]) for k in range(1, len(mark) + 1)):
                return True
        return False

    def enter(start: Node) -> None:
        """Takes a subtree in, up to the marked elements in it."""
        nonlocal left, stated
        todo = [(start, False)]
        while todo:
            node, linked = todo.pop()
            if node.marks and id(node) not in around and node is not start and live(node):
                edge[id(node)] = node
                for mark in node.marks:
                    if plain[id(node)]:
                        amount[mark] = amount.get(mark, 0) + plain[id(node)]
                    for k in range(1, len(mark) + 1):
                        under.setdefault(mark[:k], {})[id(node)] = node
                continue
            stated |= node.name in KEPT_HEADER
            if not linked:
                left += sum(len(x.strip()) for x in node.children if isinstance(x, str))
            todo += [(x, linked or x.name == "a") for x in node.children if isinstance(x, Node) and not x.dropped]

    def release(node: Node) -> None:
        del edge[id(node)]
        for mark in node.marks:
            if plain[id(node)]:
                amount[mark] -= plain[id(node)]
                if not amount[mark]:
                    del amount[mark]
        enter(node)

    enter(root)
    while edge:
        if not stated:
            held = [x for x in edge.values() if article.get(id(x), 0) > left and not any(OTHER_TEXTS.intersection(m) for m in x.marks)]
            if held:
                release(max(held, key=lambda x: article[id(x)]))
                continue
        open_ = [(n, m) for m, n in amount.items() if n > 0 and m not in excused and not OTHER_TEXTS.intersection(m)]
        found = max(((n, m) for n, m in open_ if n >= (ALL if stated else MOST) * left and _speaks_of(m)), default=None)
        if found is None and left < LITTLE:
            found = max(((n, m) for n, m in open_ if n > ALL * left), default=None)
        if found is None:
            break
        excused.add(found[1])
        for node in list(under.get(found[1], {}).values()):
            if id(node) in edge and not live(node):
                release(node)
    for node in edge.values():
        node.dropped = not (inside[id(node)] and plain[id(node)] >= DOUBTFUL and all(map(_doubtful, node.marks)))


class Tags:
    """Finds the ends of tags in a page; no place is looked at more often than a few times, however the page is made."""

    def __init__(self, source: str):
        self.source = source
        self.lost: set[int] = set()
        self.no_special = self.no_end = len(source) + 1

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin here: after a > outside quotes, else after the next > at all; 0 if there is none."""
        seen, begin = [], at
        while at < self.no_special:
            found = SPECIAL.search(self.source, at)
            if found is None:
                self.no_special = at
                break
            place = found.start()
            if self.source[place] == ">":
                return place + 1
            # A quote from which on no > was found before leads nowhere again.
            if place in self.lost:
                break
            seen.append(place)
            close = self.source.find(self.source[place], place + 1)
            if close < 0:
                break
            at = close + 1
        self.lost.update(seen)
        return self.after(begin)

    def after(self, at: int) -> int:
        """After the next >; 0 if there is none."""
        if at >= self.no_end:
            return 0
        found = self.source.find(">", at)
        if found < 0:
            self.no_end = at
        return found + 1


#: Per kind of scope a bit: names that set it (an element is open that a later tag can end) and names that clear it.
_KINDS = [({"p"}, P_SCOPE), *ENDED_BY.values(), (set(KEPT_HEADER), set())]
_BITS: dict[str, tuple[int, int]] = {}
for _k, (_ends, _scope) in enumerate(_KINDS):
    for _name in {*_ends, *_scope}:
        _set, _clear = _BITS.get(_name, (0, 0))
        _BITS[_name] = _set | (_name in _ends) << _k, _clear | (_name in _scope and _name not in _ends) << _k
_OF_P, _OF_ARTICLE = 0, len(_KINDS) - 1
_OF = {name: k for k, name in enumerate(ENDED_BY, 1)}


class Path:
    """The open elements. Per element it is known which others are open around it, so that no search for one is in vain."""

    def __init__(self, root: Node):
        self.nodes, self.bits, self.open = [root], [0], Counter()
        #: Inline elements open since each open block.
        self.inline = [Counter()]

    def push(self, node: Node) -> None:
        on, off = _BITS.get(node.name, (0, 0))
        self.nodes.append(node)
        self.bits.append(self.bits[-1] & ~off | on)
        self.open[node.name] += 1
        if node.name in BLOCK:
            self.inline.append(Counter())
        else:
            self.inline[-1][node.name] += 1

    def cut(self, at: int) -> None:
        """Closes the elements from number ``at`` on."""
        while len(self.nodes) > at:
            name = self.nodes.pop().name
            self.bits.pop()
            self.open[name] -= 1
            if name in BLOCK:
                self.inline.pop()
            else:
                self.inline[-1][name] -= 1

    def close(self, name: str) -> bool:
        """Ends the innermost element of that name; an inline end tag does not end the blocks around it."""
        if not (self.open if name in BLOCK else self.inline[-1])[name]:
            return False
        at = len(self.nodes) - 1
        while self.nodes[at].name != name:
            at -= 1
        self.cut(at)
        return True

    def has(self, kind: int) -> bool:
        return bool(self.bits[-1] >> kind & 1)

    def end(self, kind: int, outermost: bool) -> None:
        """Ends the innermost or outermost element of the kind within its scope."""
        if not self.has(kind):
            return
        ends, at, cut = _KINDS[kind][0], len(self.nodes) - 1, 0
        while self.bits[at] >> kind & 1:
            if self.nodes[at].name in ends:
                cut = at
                if not outermost:
                    break
            at -= 1
        self.cut(cut)


def parse(source: str) -> Node:
    """The tree below the body. Missing end tags are supplied, end tags without a start are passed over.

    The work is in proportion to the page, also where quotes, tags or elements are never closed.
    """
    root = Node("body")
    path, tags, at, n = Path(root), Tags(source), 0, len(source)
    while at < n:
        tag = source.find("<", at)
        if tag < 0:
            path.nodes[-1].children.append(source[at:])
            break
        found = TAG.match(source, tag)
        if source.startswith("<!--", tag):
            end = source.find("-->", tag + 4) + 3
            end = end if end > 2 else n
        elif found is not None:
            end = tags.end(found.end())
        else:
            end = tags.after(tag) if source[tag + 1 : tag + 2] in ("!", "?") else 0
        if not end:
            # A bracket that opens nothing is text.
            path.nodes[-1].children.append(source[at : tag + 1])
            at = tag + 1
            continue
        if tag > at:
            path.nodes[-1].children.append(source[at:tag])
        at = end
        if found is None:
            continue
        name = found.group(2).lower()
        if found.group(1):
            if name not in ("body", "html") and not path.close(name) and name == "p":
                path.nodes[-1].children.append(Node("p"))
            continue
        if path.nodes[-1].name == "head" and name not in IN_HEAD:
            # The end tag of a head may be left out.
            path.cut(len(path.nodes) - 1)
        if name in ("html", "body"):
            continue
        if name in ENDS_P:
            path.end(_OF_P, False)
        if name in _OF:
            path.end(_OF[name], True)
        attributes = source[found.end() : end - 1]
        node = Node(name, True) if name in DROPPED else Node(name, False, _marks(name, attributes, path.has(_OF_ARTICLE)))
        path.nodes[-1].children.append(node)
        if name in RAW:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = close.end() if close else n
        elif name not in VOID:
            path.push(node)
    return root


def measure(root: Node) -> None:
    """Counts characters and tags bottom up, then densities; without recursion, as trees may be deep."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append((node, linked))
        for x in node.children:
            if isinstance(x, Node) and not x.dropped:
                stack.append((x, linked or x.name == "a"))
    for node, linked in reversed(order):
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(x.strip())
                if linked:
                    node.link_chars += len(x.strip())
            elif not x.dropped:
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.name == "a")
    linked_share = root.link_chars / root.chars if root.chars else 0.0
    for node, _ in reversed(order):
        if node.chars:
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + linked_share * node.chars + math.e)
            value = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            node.density = node.chars / max(node.tags, 1) * math.log(max(value, 1.0)) / max(math.log(base), 1.0) if value > 1 else 0.0
        # Formatting inside a paragraph makes no paragraph an article: only blocks are summed.
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.dropped and (x.name in BLOCK or x.name not in INLINE))


def article_nodes(root: Node) -> tuple[set[int], list[Node] | None]:
    """Identities of the nodes whose subtrees are the article, and the way to the densest one (None: the page states it itself)."""
    best, stack, parent = root, [root], {}
    while stack:
        node = stack.pop()
        if node.total > best.total:
            best = node
        for x in node.children:
            if isinstance(x, Node) and not x.dropped and x.chars:
                parent[id(x)] = node
                stack.append(x)
    way = [best]
    while way[-1] is not root:
        way.append(parent[id(way[-1])])
    way.reverse()
    if best is root:
        return {id(root)}, way
    for x in reversed(way):
        if x.name in KEPT_HEADER:
            # The page itself says where its article ends.
            return {id(x)}, None
    threshold = min(x.density for x in way)
    chosen, on_way, queue = {id(best)}, {id(x) for x in way}, [root]
    while queue:
        node = queue.pop()
        for x in node.children:
            if isinstance(x, Node) and not x.dropped and x.chars and id(x) not in chosen:
                if id(x) not in on_way and x.density >= threshold:
                    chosen.add(id(x))
                else:
                    queue.append(x)
    return chosen, way


def is_menu(node: Node) -> bool:
    """A block that is mostly links, and more than one."""
    return node.name in BLOCK and node.link_tags > 1 and 3 * node.link_chars > 2 * node.chars


def numbered(node: Node) -> bool:
    """A numbered list or a block with one: of references, rather than a menu."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.name == "ol":
            return True
        stack += [y for y in x.children if isinstance(y, Node) and not y.dropped]
    return False


def main_text(source: str | None) -> str:
    """The article of a page: blocks in page order joined by one space, character references decoded.

    Menus are left out beside the densest subtree and where they begin or end it; within it they are text.
    """
    if not source:
        return ""
    root = parse(source)
    judge(root)
    measure(root)
    chosen, way = article_nodes(root)
    core, on_way = (way[-1], {id(x) for x in way}) if way else (None, set())
    parts: list[str] = []
    # Of the core: places of its own text, and of menus with whether they are numbered.
    own: list[int] = []
    menus: list[tuple[int, bool]] = []
    # Per node: whether it is part of the article, of the core, of text for its edges, and of which menu.
    stack: list[tuple[Node | str | None, bool, bool, bool, bool | None]] = [(root, False, False, True, None)]
    while stack:
        x, inside, within, plain, menu = stack.pop()
        if x is None:
            parts.append(" ")
        elif isinstance(x, str):
            if inside:
                if within and menu is not None:
                    menus.append((len(parts), menu))
                elif within and plain and not x.isspace():
                    own.append(len(parts))
                parts.append(html.unescape(x) if "&" in x else x)
        elif not x.dropped and (way is None or within or id(x) in on_way or not is_menu(x)):
            if within and menu is None and is_menu(x):
                menu = numbered(x)
            inside, within = inside or id(x) in chosen, within or x is core
            plain = plain and x.name not in NO_EDGE
            edge = [(None, False, False, False, None)] if x.name in BLOCK else []
            stack += edge
            stack += [(y, inside, within, plain, menu) for y in reversed(x.children)]
            stack += edge
        elif x.name in BLOCK:
            parts.append(" ")
    if menus:
        first = own[0] if own else len(parts)
        last = max([*own[-1:], *(k for k, listed in menus if listed and k > first)], default=0)
        for k, _ in menus:
            if not first < k <= last:
                parts[k] = " "
    return " ".join("".join(parts).split())


def extract_articles(pages: DataFrame, carry: list[str], column: str = "html") -> DataFrame:
    """``carry`` with ``text`` and ``n_chars`` (code points) of each page's article.

    Null and empty pages give an empty text. Every row is read whole and answered once, repeated or not. An empty table gives no
    rows; further columns of any name play no part. Very long and broken pages (tags, quotes and elements that are never
    closed) take time and memory in proportion to their length.
    """
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry), "text string, n_chars long"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "__html"):
            found = [main_text(x) for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*carry, "text", "n_chars"])

    return pages.select(*carry, F.col(column).alias("__html")).mapInArrow(read, schema)
