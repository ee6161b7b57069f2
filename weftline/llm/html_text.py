"""Main-text extraction by composite text density.

The page becomes a tree. A node's density is its characters per tag, scaled down where many of the characters
are link text; a node's density sum adds its children's densities. The subtree with the greatest sum is the
candidate; the least density on the path from it up to the body is the threshold, and within the chosen subtree
parts that fall below it and are mostly links are left out. An article or main element around the candidate is
taken whole, and so are its sibling articles that reach the threshold.

Elements that are no text by their name, role, class or id go first. Where a word can also mean a part of an article,
density decides: inside an article or main element such a part goes only if half of its text is links. A form, or an
element named like a part of the layout, stays if it holds most of the page's text and little of it is links.

Defined cases: a null or empty html, or one without text, gives an empty text; unclosed and stray tags are
repaired as browsers do in the common cases, in time that grows with the page's length; repeated rows are worked each;
an empty table gives an empty table; other columns are left out of the result.
"""

from __future__ import annotations

import html as markup
import math
import re

from pyspark.sql import DataFrame

from .common import map_rows, table

# --- fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
#: Elements that never hold main text.
DROPPED = frozenset("head script style noscript template svg math canvas iframe object embed applet audio video map nav aside footer form button select option input textarea label fieldset legend menu menuitem dialog datalist title noembed noframes".split())
BLOCKS = frozenset("html body address article aside blockquote br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag closes an open element of these names, up to the boundary elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
SCOPE = frozenset("table td th caption html body button object article section div main aside nav footer header form".split())
#: Words of a class or id that name what is no article text, and roles that do.
NOT_TEXT = frozenset(
    "ad ads adv adbox adslot adunit advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted commercial nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar sidebars side aside rail widget widgets footer foot masthead topbar toolbar header "
    "comment comments commentlist disqus replies reply respond responses feedback discussion cookie cookies consent gdpr disclaimer notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations teaser popular trending tags copyright legal skip hidden".split()
)
#: Of these, the ones that also name an article's own parts: inside articles density decides.
ALSO_TEXT = frozenset("header tags legal teaser aside related promotion discussion feedback responses respond side popular trending commercial search navigation".split())
#: Words of reader comments and teasers: they drop even an article element, and whatever stands inside.
NOT_EVEN_ARTICLES = frozenset("comment comments commentlist disqus reply replies respond responses discussion ad ads advert adverts advertisement sponsored teaser related promo recommended".split())
#: What stands beside such a word in a name like "cookie-notice-box" without a meaning of its own.
STRUCTURE = frozenset("area bar block body bottom box button buttons center col column container content count default entry fixed form global group head holder icon inline inner item items layout left link links list main meta mobile module page panel placeholder post primary right row secondary section site slot small sticky text title top unit wrap wrapper wide view".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())

#: A part with a layout word in its name that holds most of a page's text has at least so many characters: a page with a
#: short notice and no article has no text.
LEAST_TEXT = 140

MARKS = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag, to the > outside of quotes; or to the next >, where a quote is never closed.
TAG_END, PLAIN_END = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"), re.compile(r"([^>]*+)>")


class Node:
    __slots__ = ("chars", "children", "density", "depth", "drop", "in_article", "link_chars", "links", "name", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, drop: int = 0):
        self.name, self.parent, self.drop = name, parent, drop
        self.depth = 0 if parent is None else parent.depth + 1
        self.in_article = name in ("article", "main") or parent is not None and parent.in_article
        self.children: list[Node | str] = []


#: Degrees of dropping: not; if half of it is links; unless it holds most of the page; by a layout word (an article
#: inside shows that the word meant the page's layout); surely.
KEPT, LINKS, FORM, LAYOUT, SURE = range(5)


def named(value: str, inside: bool) -> set[str]:
    """The words of NOT_TEXT that a class or id has. Inside an article a word counts as the last of a name, or among words
    of mere structure: "cookie-notice" and "notice-box" do, "notice-period" does not. Elsewhere this holds for the words of
    ALSO_TEXT: "legal-links" is no text, "legal-news" may be."""
    found = set()
    for name in value.split():
        words = [w for w in SPLIT.split(name) if w]
        last = len(words) - 1
        while last >= 0 and (words[last] in STRUCTURE or words[last] in NOT_TEXT or words[last].isdigit()):
            last -= 1
        # What stands after the last word with a meaning of its own is what the name means.
        found |= {w for k, w in enumerate(words) if w in NOT_TEXT and (k > last or k == len(words) - 1 or not inside and w not in ALSO_TEXT)}
    return found


def boilerplate(name: str, marks: str, parent: Node) -> int:
    if name == "form":
        return FORM
    if name in DROPPED:
        return SURE
    if name in ("html", "body"):
        return KEPT
    inside = parent.in_article
    if name == "header":
        return KEPT if inside else SURE
    degree = KEPT
    for m in MARKS.finditer(marks) if marks else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            found = named(value, inside)
            if inside and found <= ALSO_TEXT:
                degree = max(degree, LINKS if found else KEPT)
            elif found & NOT_EVEN_ARTICLES or found and inside and name not in ("article", "main"):
                return SURE
            elif found and name not in ("article", "main"):
                degree = LAYOUT
        elif key == "role" and value in NOT_TEXT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
    return degree


class Tree:
    """A page's tree as it grows. The open elements of each name are at hand, so that closing one does not climb."""

    def __init__(self):
        self.root = Node("html", None)
        self.open: list[Node] = [self.root]
        self.by_name: dict[str, list[Node]] = {}
        #: how many of the outermost open elements an article was already found in
        self.seen = 0

    def nearest(self, names) -> Node | None:
        """The deepest open element of these names."""
        best = None
        for name in names:
            stack = self.by_name.get(name)
            while stack and not (stack[-1].depth < len(self.open) and self.open[stack[-1].depth] is stack[-1]):
                stack.pop()
            if stack and (best is None or stack[-1].depth > best.depth):
                best = stack[-1]
        return best

    def close(self, node: Node) -> None:
        del self.open[node.depth :]

    def close_within(self, names, bounds) -> None:
        """Close the open elements of these names that no boundary stands before."""
        found = self.nearest(names)
        bound = self.nearest(bounds) if found else None
        while found and (bound is None or found.depth > bound.depth):
            self.close(found)
            found = self.nearest(names)

    def add(self, name: str, marks: str) -> None:
        self.seen = min(self.seen, len(self.open))
        parent = self.open[-1]
        node = Node(name, parent, boilerplate(name, marks, parent))
        parent.children.append(node)
        self.open.append(node)
        self.by_name.setdefault(name, []).append(node)
        if name in ("article", "main") and node.drop == KEPT:
            # What holds an article is layout, whatever its name; above the first such element that was already found.
            for k in range(len(self.open) - 2, self.seen - 1, -1):
                up = self.open[k]
                if up.drop in (LAYOUT, FORM):
                    up.drop = KEPT
                if up is not parent and up.in_article:
                    break
            else:
                self.seen = len(self.open) - 1

    def put(self, x: Node | str) -> None:
        self.open[-1].children.append(x)


def parse(page: str) -> Node:
    """The page's tree. Text stands undecoded in the children's lists."""
    tree, at, end, last = Tree(), 0, len(page), page.rfind(">")
    text_from = 0

    def text_to(place: int) -> None:
        if place > text_from:
            tree.put(page[text_from:place])

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            text_to(at)
            close = page.find("-->", at + 4)
            text_from = at = close + 3 if close >= 0 else end
            continue
        if page.startswith("<![CDATA[", at):
            close = page.find("]]>", at)
            text_to(at)
            tree.put(page[at + 9 : close if close >= 0 else end])
            text_from = at = close + 3 if close >= 0 else end
            continue
        if at > last:
            break  # no tag ends any more
        if page[at + 1 : at + 2] in ("!", "?"):
            text_to(at)
            text_from = at = page.find(">", at) + 1
            continue
        m = NAME.match(page, at + 1)
        if m is None:
            at += 1
            continue
        rest = TAG_END.match(page, m.end()) or PLAIN_END.match(page, m.end())
        text_to(at)
        text_from = at = rest.end()
        name, marks = m[2].lower(), rest[1]
        if m[1]:
            if name == "br":
                tree.put(Node("br", tree.open[-1]))
            elif (found := tree.nearest((name,))) is not None:
                bound = None if name in BLOCKS else tree.nearest(("td", "th", "article", "body"))
                if bound is None or found.depth >= bound.depth:
                    tree.close(found)
            continue
        if name in ("html", "body"):
            if name == "body":
                del tree.open[1:]
                tree.add(name, "")
            continue
        if name in CLOSES_P:
            tree.close_within({"p"}, SCOPE)
            if name in HEADINGS and tree.open[-1].name in HEADINGS:
                tree.open.pop()
        if name in CLOSES:
            tree.close_within(CLOSES[name], BOUNDS[name])
        if name in VOID or marks.rstrip().endswith("/") and name not in BLOCKS and name not in RAW:
            if name in ("br", "hr"):
                tree.put(Node(name, tree.open[-1]))
            continue
        if name in RAW:
            close = RAW_END[name].search(page, at)
            text_from = at = close.end() if close else end
            continue
        tree.add(name, marks)
    text_to(end)
    return tree.root


def order_of(root: Node, dropped: bool = False) -> list[Node]:
    """Nodes that are not surely dropped (or only the kept ones), parents before children."""
    out, stack = [], [root]
    most = LAYOUT if dropped else LINKS
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and c.drop <= most]
    return out


def weigh(root: Node) -> list[Node]:
    """Decide on forms and parts by their text; set chars, tags, link characters, link tags, density and density sum of
    every kept node."""
    for decided in (False, True):
        nodes = order_of(root, dropped=not decided)
        if not decided and not any(n.drop for n in nodes):
            continue
        for node in reversed(nodes):
            inside = [c for c in node.children if isinstance(c, Node) and c.drop <= (LINKS if decided else FORM)]
            node.chars = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.chars for c in inside)
            node.tags = len(inside) + sum(c.tags for c in inside)
            node.link_chars = node.chars if node.name == "a" else sum(c.link_chars for c in inside)
            node.links = (node.name == "a") + sum(c.links for c in inside)
            if node.drop == LINKS and 2 * node.link_chars >= node.chars:
                node.drop = SURE
        if not decided:
            # The text of a part that a layout word would drop counts for the page, not for what the part stands in.
            whole = root.chars + sum(n.chars for n in nodes if n.drop == LAYOUT)
            for node in nodes:
                if node.drop == FORM:
                    node.drop = KEPT if 3 * node.chars > 2 * whole else SURE
                elif node.drop == LAYOUT and node.chars >= LEAST_TEXT and 3 * node.chars > 2 * whole and 4 * node.link_chars < node.chars:
                    up = node
                    while up is not None:
                        up.drop = KEPT if up.drop in (LAYOUT, FORM) else up.drop
                        up = up.parent
    nodes = order_of(root)
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.links
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            ratio = max(1.0, (c / max(1, lc)) * (t / max(1, lt)))
            node.density = c / t * math.log(ratio) / base if ratio > 1 else 0.0
        node.sum = sum(x.density for x in node.children if isinstance(x, Node) and x.drop <= LINKS)
    return nodes


def articles_beside(one: Node, threshold: float) -> list[Node | str]:
    """An article and its siblings of some length, in page order. A part is short of the whole, so half of the path's
    density will do."""
    if one.parent is None or one.name != "article":
        return [one]
    return [c for c in one.parent.children if c is one or isinstance(c, Node) and c.name == "article" and beside(c, threshold / 2) and 4 * c.chars >= one.chars]


def choose(root: Node, nodes: list[Node]) -> tuple[list[Node | str], float]:
    """The subtrees of the main text and the threshold of the path above the densest."""
    best = max(nodes, key=lambda n: (n.sum, -n.tags))
    if best.sum <= 0:
        best = root
    threshold, node, whole = best.density, best, None
    while node is not None:
        if node.density:
            threshold = min(threshold, node.density)
        if node.name in ("article", "main"):
            whole = node
        node = node.parent
    if whole is not None:
        return articles_beside(whole, threshold), threshold
    articles = [n for n in nodes if n.name == "article" and n.chars and not (n.parent and n.parent.in_article)]
    if articles and sum(n.chars for n in articles) >= best.chars:
        longest = max(articles, key=lambda n: n.chars)
        return [n for n in articles if n is longest or beside(n, threshold / 2) and 4 * n.chars >= longest.chars], threshold
    # Beside the path: what is as dense as the path itself and no list of links, and headings before it.
    parts: list[Node | str] = [best]
    node = best
    while node.parent is not None:
        here = next(k for k, c in enumerate(node.parent.children) if c is node)
        before, after = node.parent.children[:here], node.parent.children[here + 1 :]
        parts = [c for c in before if beside(c, threshold) or isinstance(c, Node) and c.drop <= LINKS and c.name in ("h1", "h2") and c.chars] + parts + [c for c in after if beside(c, threshold)]
        node = node.parent
    return parts, threshold


def beside(part: Node | str, threshold: float) -> bool:
    if isinstance(part, str):
        return len(part.strip()) > threshold
    return part.drop <= LINKS and part.chars > 0 and part.density >= threshold and 2 * part.link_chars <= part.chars


def blocks(node: Node | str, threshold: float) -> list[str]:
    """Texts of the blocks below a node, in page order; white space made one blank."""
    out, run = [], []

    def flush():
        text = " ".join(markup.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.drop <= LINKS:
            if x is not node and x.links > 2 and x.name != "a" and x.density < threshold and x.link_chars > 0.8 * x.chars and x.name in BLOCKS and x.name not in ("p", "td", "th"):
                continue
            block = x.name in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    parts, threshold = choose(root, weigh(root))
    return " ".join(t for p in parts for t in blocks(p, threshold))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""

    def row(page_id, url, page):
        text = main_text(page)
        return page_id, url, text, len(text)

    return map_rows(pages, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", lambda: row)


def op2(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
