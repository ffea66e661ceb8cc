"""Pages: density against a plain computation on random trees, hostile pages, doubtful names."""

import math
import random
import time

import pytest

from seqloom.llm import pages
from seqloom.llm.pages import BLOCK, INLINE, Node


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        words = " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 25)))
        if kind < 0.35 or depth > 5:
            out.append(f"<p>{words}</p>")
        elif kind < 0.5:
            out.append(f"<a href=x>{words[:20]}</a>")
        else:
            name = rng.choice(["div", "section", "ul", "b", "table"])
            out.append(f"<{name}>{random_page(rng, depth + 1)}</{name}>")
    return "".join(out)


def below(node):
    return [x for x in node.children if isinstance(x, Node)]


def subtree(node):
    return [y for x in below(node) for y in [x, *subtree(x)]]


def texts(node, linked=False):
    """(text, whether under a link) of a subtree, the node itself included."""
    linked = linked or node.name == "a"
    out = [(x.strip(), linked) for x in node.children if isinstance(x, str)]
    return out + [t for x in below(node) for t in texts(x, linked)]


def plain_density(node, root, above):
    own, whole = texts(node, above), texts(root)
    chars, link_chars = sum(len(t) for t, _ in own), sum(len(t) for t, link in own if link)
    tags, link_tags = len(subtree(node)), sum(x.name == "a" for x in subtree(node))
    share = sum(len(t) for t, link in whole if link) / max(sum(len(t) for t, _ in whole), 1)
    if not chars:
        return 0.0
    value = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / max(tags, 1) * math.log(value) / max(math.log(base), 1.0) if value > 1 else 0.0


@pytest.mark.parametrize("seed", range(25))
def test_density_and_choice(seed):
    root = pages.parse(random_page(random.Random(seed)))
    pages.measure(root)
    parent, density = {}, {}

    def walk(node, linked):
        density[id(node)] = plain_density(node, root, linked)
        for x in below(node):
            parent[id(x)] = node
            walk(x, linked or node.name == "a")

    walk(root, False)
    every = [root, *subtree(root)]
    assert all(x.density == pytest.approx(density[id(x)]) for x in every)
    total = {id(x): sum(density[id(y)] for y in below(x) if y.name in BLOCK or y.name not in INLINE) for x in every}
    chosen, way = pages.article_nodes(root)
    assert total[id(way[-1])] == pytest.approx(max(total.values()))
    if way == [root]:
        assert chosen == {id(root)}
        return
    assert way[0] is root and all(parent[id(y)] is x for x, y in zip(way, way[1:], strict=False))
    on_way, least = {id(x) for x in way}, min(density[id(x)] for x in way)

    def owner(x):
        """The outermost element around x that is dense enough and not on the way, or the densest one."""
        line = [x]
        while line[-1] is not root:
            line.append(parent[id(line[-1])])
        return next((y for y in reversed(line) if y is way[-1] or (id(y) not in on_way and y.chars and y.density >= least)), None)

    assert chosen == {id(y) for x in every if (y := owner(x)) is not None}


HOSTILE = {
    "open double quotes": ('<a "', ""), "open tags": ("<a ", ""), "stray ends": ("</i>", "<b>" * 10_000), "quoted ends": ('<a ">" ', ""),
    "mixed quotes": ("<a '\"> ", ""), "brackets": ("<", ""), "glued names": ("<a", ""), "headings in spans": ("<h1></h1>", "<span>" * 10_000),
    "items in spans": ("<li>x", "<ul>" + "<span>" * 10_000), "cells in spans": ("<td>x", "<table>" + "<b>" * 10_000), "headers": ("<header>", ""),
    "nested": ("<div>", ""), "paragraphs": ("<p>x<b>", ""), "declarations": ("<!x", ""), "comments": ("<!--", ""), "boxes": ("<i><div>", ""),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    piece, before = HOSTILE[name]
    begin = time.process_time()
    pages.main_text(before + piece * ((1 << 20) // len(piece)))
    assert time.process_time() - begin < 8


@pytest.mark.parametrize(
    "box, kept",
    [
        ('<div id="side-effects">{}</div>', True), ('<div class="share-price">{}</div>', True), ('<section class="legal-history">{}</section>', True),
        ('<div class="comment-policy">{}</div>', True), ('<math><mtext>{}</mtext></math>', True), ('<div class="comments-area">{}</div>', False),
        ('<div class="sidebar-right">{}</div>', False), ('<aside>{}</aside>', False), ('<div class="share">{}</div>', False), ('<div role="navigation">{}</div>', False),
        ('<div id="side-effects"><a href=x>{}</a></div>', False),
    ],
)
def test_names_in_an_article(box, kept):
    article, inner = "The article says many things. " * 20, "What is told here has a length of its own. " * 5
    page = f"<html><body><article><p>{article}</p>{box.format(inner)}<p>It ends here.</p></article></body></html>"
    want = (article + inner * kept + "It ends here.").split()
    assert pages.main_text(page).split() == want
