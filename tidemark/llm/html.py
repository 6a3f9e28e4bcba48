"""Main text of web pages by scoring the containers of their paragraphs.

Each paragraph passes points to its parent and, halved, to its grandparent and on at falling shares; the points grow with its length and
commas. A container's score is discounted by its link density. The best container is kept, and those of its siblings
that score well or are prose themselves. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and styles are dropped before scoring, by element and by the words of their class, id and role.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_of, with_columns_from

#: Elements by what HTML says of them (fixed values).
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "menu", "dialog", "audio", "video", "map"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br",
} | DROPPED
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "button", "select", "option", "object", "audio", "video", "map", "svg", "canvas"} - RAW
#: An element that ends an open one of these, up to a boundary.
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = {"div", "article", "section", "main", "body", "html", "table", "td", "th", "ul", "ol", "dl", "li", "blockquote", "aside", "nav", "header", "footer", "form", "figure"}
#: Elements that may be dropped by their names: what holds other blocks. A paragraph, a heading or a piece of a line isn't.
NAMED = {"article", "div", "section", "header", "ul", "ol", "dl", "table", "center", "details", "figure", "fieldset", "address"}
#: Words of class, id and role that mark what isn't part of an article, wherever it stands, and those that do so outside of
#: one; and words that may stand beside them in one name (fixed values).
NEVER = set(
    "ad ads adsense adslot advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus cookie cookies consent gdpr masthead menubar nav navbar navigation "
    "newsletter notification notifications pagination pager popup modal overlay promo promos promotion related recommend recommended recommendations share sharing sidebar social sponsor sponsored sponsors subscribe subscription "
    "signup login toolbar outbrain taboola skip contentinfo complementary".split()
)
OUTSIDE = set("footer header menu notice notices alert alerts side widget widgets search legal disclaimer copyright author bio tag tags hidden".split())
BESIDE = set(
    "site page global top bottom left right main primary secondary post article entry blog story box block area container wrap wrapper outer inner section sections list lists bar bars item items group row column col panel strip "
    "form link links button buttons icon icons text title head heading content contents reader readers user users thread posts articles stories and to the by a of more read now us on me bg sticky fixed float header footer menu notice widget widgets slot unit zone space holder inline".split()
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|prose)(?:$|[\s_-])", re.I)
#: Whole names that mark the article itself.
ARTICLE = re.compile(r"(?:^|\s)(?:h?entry|(?:blog-?|single-?)?(?:article|post|story)|(?:article|post|entry|story)[_-]?(?:body|content|text))(?:\s|$)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|$)|'[^']*'(?=[\s/>]|$)|[\"'])*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANK = re.compile(r"\s+")
WORDS = re.compile(r"[A-Za-z]+")
#: Bytes of pages worked on at a time in a task.
PORTION = 1_000_000
#: Elements whose text counts for the element around them.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "br", "pre", "li", "dd", "dt", "td", "th", "figcaption", "b"}


#: Why an element goes: not at all, for what it is, by its name, by its name though an article is around it.
STAYS, OUT, BY_NAME, WITHIN = 0, 1, 2, 3
#: How a sentence ends.
SENTENCE = re.compile(r"[.!?\u2026][\"'\u2019\u201d\u00bb)]*$")


class Node:
    """An element; `block` is the nearest block around its text, `score` what paragraphs passed to it, `out` why it goes."""

    __slots__ = ("tag", "parent", "kids", "score", "chars", "linked", "out", "dropped", "bonus", "block", "named", "kept", "heads", "prose")

    def __init__(self, tag: str, parent: Node | None, out: int, bonus: float, named: bool = False):
        self.tag, self.parent, self.out, self.bonus, self.named = tag, parent, out, bonus, named
        self.dropped, self.heads, self.prose = False, 0, True
        self.block: Node = self if tag in BLOCKS or parent is None else parent.block
        self.kids: list[Node] = []
        self.score, self.chars, self.linked, self.kept = 0.0, 0, 0, False


class Open:
    """The open elements from the root down, with the depths at which each kind is open."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes = [root], {}, [0]

    def push(self, n: Node) -> None:
        self.at.setdefault(n.tag, []).append(len(self.stack))
        if n.tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(n)

    def deepest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close_to(self, depth: int) -> None:
        """Ends the element at that depth and all inside it."""
        while len(self.stack) > max(1, depth):
            n = self.stack.pop()
            self.at[n.tag].pop()
            if n.tag in SCOPES:
                self.scopes.pop()


def unlikely(marks: str, in_article: bool) -> bool:
    """Whether one of the names consists of words that mark what isn't article, and of words that may stand beside them."""
    for name in marks.split():
        words = {w.lower() for w in WORDS.findall(CAMEL.sub("-", name))}
        bad = words & NEVER or not in_article and words & OUTSIDE
        if bad and words <= NEVER | OUTSIDE | BESIDE:
            return True
    return False


def settle(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Marks what is dropped, given all elements, parents first, and returns the blocks that stay.

    A block named as something else stays in an article if it holds the page's only h1. An article inside an article that
    has prose of its own is a reader's comment, as HTML has it.
    """
    for n in reversed(nodes):
        n.heads += n.tag == "h1"
        if n.parent is not None:
            n.parent.heads += n.heads
    articles: dict[Node, Node] = {}
    for n in nodes[1:]:
        if n.tag == "article":
            articles[n] = n
        elif n.parent in articles:
            articles[n] = articles[n.parent]
    own = {articles[o] for o, s, _ in blocks if o in articles and len(s) >= 25 and o.tag in ("p", "div", "section", "article", "blockquote", "li")}
    for n in nodes[1:]:
        rescued = n.out == WITHIN and n.heads == 1 and nodes[0].heads == 1
        comment = n.tag == "article" and articles.get(n.parent) in own
        n.dropped = n.parent.dropped or n.out != STAYS and not rescued or comment
    return [b for b in blocks if not b[0].dropped]


def tree(page: str, by_name: bool = True) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements, parents first, and the text blocks (owner, text, characters within links) in page order. by_name: drop by class, id and role too."""
    root = Node("#root", None, STAYS, 0.0)
    nodes, blocks, text, up = [root], [], [], Open(root)
    state = {"link": 0, "owner": root, "anchors": 0}

    def close() -> None:
        if text:
            s = BLANK.sub(" ", unescape("".join(text))).strip()
            text.clear()
            linked = min(state["link"], len(s))
            # A line of several links and nothing else is a menu.
            menu = state["anchors"] > 1 and state["owner"].tag not in ("li", "td", "dd") and linked >= 0.9 * (len(s) - s.count(" ")) and not SENTENCE.search(s)
            if s and not menu:
                blocks.append((state["owner"], s, linked))
        state["link"] = state["anchors"] = 0

    def add(s: str, in_link: bool) -> None:
        if s:
            if not text:
                state["owner"] = up.stack[-1].block
            text.append(s)
            state["link"] += len(s.strip()) if in_link else 0

    at, links = 0, 0
    m = TOKEN.search(page)
    while m:
        add(page[at : m.start()], links > 0)
        at, tag = m.end(), (m[2] or "").lower()
        if tag in BLOCKS:
            close()
        if tag and m[1]:
            depth = up.deepest((tag,))
            if depth and (tag in SCOPES or depth > up.scopes[-1]):
                up.close_to(depth)
            links = max(0, links - 1) if tag == "a" else links
        elif tag:
            # An anchor doesn't reach over a block that a forgotten end tag leaves it in.
            links = 0 if tag in SCOPES else links
            if tag in ENDS_P and up.deepest(("p",)) > up.scopes[-1]:
                up.close_to(up.deepest(("p",)))
            if tag in SAME:
                ends, stop = SAME[tag]
                while up.deepest(ends) > up.deepest(stop):
                    up.close_to(up.deepest(ends))
                    if tag != "tr":
                        break
            given = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(m[3]))} if m[3] else {}
            in_article = bool(up.at.get("article") or up.at.get("main"))
            # The id of a section in an article is where a link leads to, not what it is.
            marks = " ".join(given[k] for k in ("class", "id", "role") if k in given and not (k == "id" and tag == "section" and in_article))
            hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(given.get("style", "")))
            named_out = by_name and tag in NAMED and bool(marks) and unlikely(marks, in_article)
            out = OUT if tag in DROPPED or hidden or tag == "header" and not up.at.get("article") else (WITHIN if in_article else BY_NAME) if named_out else STAYS
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            elif tag not in VOID and not m[0].endswith("/>") or tag in BLOCKS - VOID:
                parent = up.stack[-1]
                child = Node(tag, parent, out, 25.0 if marks and LIKELY.search(marks) else 0.0, tag in ("article", "main") or tag in NAMED and bool(ARTICLE.search(marks)))
                parent.kids.append(child)
                nodes.append(child)
                up.push(child)
                links += tag == "a"
                state["anchors"] += tag == "a"
        m = TOKEN.search(page, at)
    add(page[at:], links > 0)
    close()
    return nodes, settle(nodes, blocks)


def wrapper(n: Node) -> Node:
    """The article that a container belongs to: the outermost <article> around it, else the nearest <main> or element named as an article, else itself."""
    article, nearest, up = None, None, n
    while up is not None:
        if up.tag == "article":
            article = up
        if up.named and nearest is None:
            nearest = up
        up = up.parent
    return article or nearest or n


def only_links(owner: Node) -> bool:
    """Whether a list item stands in a list of three or more that is nearly all links: a menu."""
    up = owner.parent
    return owner.tag == "li" and up is not None and len(up.kids) >= 3 and up.linked > 0.8 * up.chars


def main_text(page: str | None) -> str:
    """The article of a page; a page without paragraphs gives all its text that isn't dropped, an empty or null one nothing."""
    if not page:
        return ""
    # Where the names of elements rule everything out, they are no guide.
    nodes, blocks = tree(page)
    if not blocks:
        nodes, blocks = tree(page, by_name=False)
    if not blocks:
        return ""
    for owner, s, linked in blocks:
        owner.prose = owner.prose and bool(SENTENCE.search(s))
        owner.chars += len(s)
        owner.linked += linked
        # A block passes points to the containers around it; a paragraph element isn't a container itself.
        points = 1 + s.count(",") + min(len(s) / 100, 3.0) if len(s) >= 25 else 0.2
        points *= 1 - linked / len(s)
        n = owner.parent if owner.tag in LEAVES and owner.parent else owner
        share = 1.0
        while n is not None and share > 0.01:
            n.score += points * share
            share = share / 2 if share == 1 else share / 1.5
            n = n.parent
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked
        n.parent.prose = n.parent.prose and n.prose

    def worth(n: Node) -> float:
        return (n.score + (n.bonus if n.score > 0 else 0) + (25.0 if n.tag in ("article", "main") else 0)) * (1 - n.linked / max(1, n.chars))

    choices = [n for n in nodes if n.chars and n.tag not in ("html", "p", "b", "a", "span", "h1", "h2", "h3")]
    if not choices:
        return " ".join(s for _, s, _ in blocks)
    best = max(choices, key=worth)
    limit = max(10.0, 0.2 * worth(best))
    chosen = wrapper(best)
    sure = chosen.named
    chosen.kept = True
    for sib in chosen.parent.kids if chosen.parent is not None and chosen.tag not in ("article", "main") else []:
        if sib is chosen or sib.dropped or not sib.chars:
            continue
        density = sib.linked / sib.chars
        good = sib.tag not in ("p", "b", "a", "span", "h1", "h2", "h3") and worth(sib) >= limit and density < 0.3
        # Sentences without a link are prose, however few.
        if good or density == 0 and sib.prose and sib.tag in ("div", "section", "blockquote") or sib.tag == "p" and (sib.chars > 80 and density < 0.25 or density == 0 and sib.chars > 20) or sib.tag in ("h1", "h2") and density == 0:
            sib.kept = True
    for n in nodes[1:]:
        n.kept = n.kept or n.parent.kept
    # In an article a list of links is a list of references; elsewhere it is a menu.
    return " ".join(s for owner, s, _ in blocks if owner.kept and (sure or not only_links(owner)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """id, `keep` columns, text and n_chars of each row; each page is read whole, rows stay where they are.

    Defined results: a null or empty page has the text ''; repeated rows and null ids are handled row by row; of containers
    that tie the first one is taken; other columns aren't read, whatever their names; an empty table gives an empty result.
    """
    d = pages.select(id_col, *(keep or []), text_of(html_col).alias("__html"))
    done = with_columns_from(d, "__html", lambda pages: [[main_text(x) for x in pages]], {"text": "string"}, PORTION)
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["url"])
