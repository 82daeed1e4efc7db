"""Main-text extraction by tree scoring.

Each paragraph gives points for its length and commas to its ancestors: fully to the nearest, half
as much to each further one (articles and mains get them in full). A container's points are
discounted by its link density; the best container and those siblings that also score are kept, with
the paragraphs between them. What an element's class says of it only raises a doubt, which the
element's own text can defend. Reader comments are told by class, by a heading that says so, or by
their structure: siblings of one kind that each have an author and a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in a page, and words of class names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style noscript template head title nav footer button select option textarea input "
              "iframe object svg canvas dialog menu audio video map datalist".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = set("p li td th pre blockquote dd dt figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo search dialog alert alertdialog menu menubar toolbar".split())
NEGATIVE = set("nav navbar navigation menu menubar sidebar aside footer header masthead banner ad ads advert adverts "
               "advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal "
               "overlay newsletter subscribe subscription signup share sharing social related recommended breadcrumb "
               "breadcrumbs pagination pager login toolbar widget comment comments disqus reply replies respond".split())
READERS = set("comment comments disqus reply replies".split())
#: Words that also stand for what prose is about, and whose elements it can defend.
SOFT = set("social share sharing related header menu aside promotion".split())
PEOPLE = set("user users customer customers reader readers visitor visitors guest guests".split())
AUTHORS = set("author user username nickname name commenter avatar byline fn vcard poster".split())
TIMES = set("date datetime time timestamp ago posted published".split())
SAYS_COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|visitor)s?['’]? )?(?:comments?|replies|kommentare?|commentaires?|comentarios?)(?: ?\(?\d+\)?)?:?"
                           r"|\d+ responses?:?|leave a (?:comment|reply)|join the (?:discussion|conversation)|what do you think\??", re.IGNORECASE)
#: Words that leave a name like "site-header" or "ad-slot" as plain as "header" or "ad".
FRAME = set("area article articles bar block bottom box button buttons container content icons inner item items left link links list "
            "main outer page panel post posts reader right section site slot top unit user users wrap wrapper".split())
#: Start tags that end an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
KEEP, DOUBTFUL, DEFENSIBLE, PLAIN, READER, NEVER = range(6)
LEAST = 60  # characters of a text that speaks for itself


def words_of(name: str) -> set[str]:
    """The lower-case words of a class name or id, camel case cut; names that begin with "comment" count as it."""
    words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}
    return {"comments" if w.startswith("comment") and not w.startswith(("commentar", "commentat", "commenter")) else w for w in words}


class Node:
    __slots__ = ("tag", "parent", "block", "depth", "items", "doubt", "inside", "dropped", "wraps", "kept", "size", "linked", "stops", "given", "points", "total", "name", "author", "time", "leads")

    def __init__(self, tag: str, parent: Node | None, doubt: int = KEEP, inside: bool = False, name: str = ""):
        self.tag, self.parent, self.doubt, self.inside, self.name = tag, parent, doubt, inside, name
        words = words_of(name) if name else set()
        self.author, self.time, self.leads = tag == "cite" or bool(words & AUTHORS), tag == "time" or bool(words & TIMES), tag in ("main", "h1")
        self.block: Node = parent.block if parent and tag in INLINE else self
        self.depth = parent.depth + 1 if parent else 0
        self.items: list[Node | str] = []
        self.dropped = self.kept = False
        self.wraps = tag in ("article", "main", "h1")
        self.size = self.linked = self.stops = 0
        self.given = self.points = self.total = 0.0


def doubt_of(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """What tag, role and class make of an element; ``inside``: it is in an article or main."""
    if tag in DROPPED or tag == "header" and not inside:
        return NEVER
    a = dict(attrs)
    role = (a.get("role") or "").lower()
    if role in ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true":
        return NEVER
    if "display:none" in (a.get("style") or "").replace(" ", "").lower():
        return NEVER
    if tag in ("html", "body", "main"):
        return KEEP
    out = KEEP
    if tag == "aside" or role == "complementary":
        out = DOUBTFUL if inside else NEVER
    if tag == "form" or role == "form":
        out = PLAIN
    known = READERS if tag in ("article", "h1") or tag == "header" else NEGATIVE
    for name in f"{a.get('class') or ''} {a.get('id') or ''}".split():
        words = words_of(name)
        bad = words & known
        if words & PEOPLE and words & {"review", "reviews"}:
            out = max(out, READER)
        elif bad:
            plain = words <= known | FRAME
            out = max(out, READER if plain and bad & READERS else DOUBTFUL if not plain else DEFENSIBLE if bad <= SOFT else PLAIN)
    return out


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.nodes = [self.root]  # parents before their children
        self.open: Counter = Counter()

    def close_to(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:  # a block ends an open paragraph, with what is open in it
            node = self.at.block
            if node.tag in {"p", *HEADINGS} and (node.tag == "p" or tag in HEADINGS):
                self.close_to(node.parent)
        if tag in ENDS and any(self.open[t] for t in ENDS[tag]):
            node = self.at
            while node.parent and node.tag not in ENDS[tag] and node.tag not in STOPS[tag]:
                node = node.parent
            if node.tag in ENDS[tag]:
                self.close_to(node.parent)
        inside = self.open["article"] + self.open["main"] > 0
        new = Node(tag, self.at, doubt_of(tag, attrs, inside), inside, next((v or "" for k, v in attrs if k == "class"), ""))
        self.nodes.append(new)
        self.at.items.append(new)
        if tag not in VOID:
            self.at = new
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.parent and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return  # an inline end tag doesn't close blocks
            node = node.parent
        if node.parent:
            self.close_to(node.parent)

    def handle_data(self, data):
        self.at.items.append(data)


def speaks(node: Node) -> bool:
    """Is the element's own text that of an article: sentences, hardly any links?"""
    return node.size >= LEAST and node.stops > 0 and 4 * node.linked < node.size


def guilty(node: Node) -> bool:
    """Is the doubt in an element confirmed by what is in it?"""
    if node.doubt in (KEEP, NEVER, READER):
        return node.doubt != KEEP
    if node.wraps:
        return False
    if node.doubt == DEFENSIBLE and node.inside and node.tag not in INLINE:
        return not speaks(node)
    if node.doubt in (DEFENSIBLE, PLAIN):
        if node.tag in INLINE:
            return node.size < LEAST
        leaf = node.inside and (node.tag in PARAGRAPHS or node.tag in HEADINGS)
        return not (leaf and speaks(node))
    return 2 * node.linked > node.size if node.inside or node.tag in INLINE else not speaks(node)


def short_text(node: Node, most: int = 60) -> str:
    """The element's text if it has ``most`` characters at most, else nothing."""
    out, todo, size = [], [node], 0
    while todo and size <= most:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            size += len(x)
        else:
            todo += reversed(x.items)
    return " ".join("".join(out).split()) if size <= most else ""


def mark_comments(nodes: list[Node]) -> None:
    """Doubt what a heading calls comments, and siblings of one kind that each have an author and a time."""
    root = nodes[0]
    for node in nodes:
        if node.tag in HEADINGS and node.size and SAYS_COMMENTS.fullmatch(short_text(node)):
            up = node.parent
            items = [x for x in up.items if isinstance(x, Node) and x.size or isinstance(x, str) and x.strip()]
            if items[0] is node and up.tag not in ("article", "main", "body", "html", "#root") and not up.leads:
                up.doubt = max(up.doubt, READER)
                continue
            for x in items[items.index(node) + 1:]:
                if isinstance(x, str) or x.tag in HEADINGS or x.tag in PARAGRAPHS or x.tag in INLINE or x.leads:
                    break
                x.doubt, node.doubt = max(x.doubt, READER), READER
    for node in nodes:
        alike = Counter((x.tag, x.name) for x in node.items if isinstance(x, Node) and x.author and x.time and x.size and not x.leads)
        if not alike or max(alike.values()) < 2:
            continue
        posts = [x for x in node.items if isinstance(x, Node) and x.author and x.time and x.size and alike[x.tag, x.name] > 1]
        if root.size - sum(x.size for x in posts) >= 3 * LEAST and root.stops - sum(x.stops for x in posts) >= 2:  # the page has a text besides
            for x in posts:
                x.doubt = max(x.doubt, READER)


def drop_boilerplate(nodes: list[Node]) -> None:
    """Sum up texts, links and stops from the leaves to the root, then drop from the root to the leaves."""
    for node in reversed(nodes):
        if node.doubt == NEVER:
            node.size = node.linked = node.stops = 0
            node.wraps = node.author = node.time = node.leads = False
            continue
        for x in node.items:
            if isinstance(x, str):
                node.size += len(x.strip())
                node.stops += sum(map(x.count, ".!?…。！？।؟"))
        if node.tag == "a":
            node.linked = node.size
        up = node.parent
        if up:
            up.size, up.linked, up.stops = up.size + node.size, up.linked + node.linked, up.stops + node.stops
            up.wraps = up.wraps or node.wraps and node.doubt != READER
            up.author, up.time, up.leads = up.author or node.author, up.time or node.time, up.leads or node.leads
    mark_comments(nodes)
    for node in nodes:
        node.dropped = bool(node.parent and node.parent.dropped) or guilty(node)


def blocks_of(root: Node) -> list[tuple[Node, str, int]]:
    """(owner, text, linked characters) of each text block outside boilerplate, in page order."""
    out, parts, linked = [], [], [0]

    def flush(owner):
        text = " ".join("".join(parts).split())
        if text:
            out.append((owner, text, min(linked[0], len(text))))
        parts.clear()
        linked[0] = 0

    stack: list[tuple[Node, Iterator, Node, bool]] = [(root, iter(root.items), root, False)]
    while stack:
        node, items, owner, link = stack[-1]
        for x in items:
            if isinstance(x, str):
                if not node.dropped:
                    parts.append(x)
                    linked[0] += len(x.strip()) if link else 0
            elif x.tag in ("br", "wbr", "img"):
                parts.append("" if x.tag == "wbr" else " ")
            elif not x.dropped:
                inline = x.tag in INLINE
                if not inline:
                    flush(owner)
                stack.append((x, iter(x.items), owner if inline else x, link or x.tag == "a"))
                break
            elif x.tag not in INLINE:
                flush(owner)
        else:
            stack.pop()
            if node.tag not in INLINE:
                flush(owner)
    return out


def score_of(node: Node) -> float:
    points = node.total if node.tag in ("article", "main") else node.points
    return points * (1 - node.linked / node.size) if node.size else 0.0


def score_tree(tree: TreeBuilder) -> list[tuple[Node, str, int]]:
    """The text blocks, whose points are given to their containers and passed on to all ancestors."""
    blocks = blocks_of(tree.root)
    mixed = {id(n.parent) for n, _, _ in blocks if n.parent}
    for node in tree.nodes:
        node.size = node.linked = 0
    for owner, text, linked in blocks:
        owner.size += len(text)
        owner.linked += linked
        if owner.tag not in HEADINGS:
            commas = sum(map(text.count, ",،、，"))
            leaf = owner.tag in PARAGRAPHS or owner.tag == "div" and id(owner) not in mixed
            (owner.parent if leaf and owner.parent else owner).given += (1 + commas + min(len(text) / 100, 3)) * (1 - linked / len(text))
    for node in reversed(tree.nodes):  # children have theirs before it goes on to the parent
        node.points, node.total = node.points + node.given, node.total + node.given
        up = node.parent
        if up:
            up.size, up.linked = up.size + node.size, up.linked + node.linked
            up.points, up.total = up.points + node.points / 2, up.total + node.total
    return blocks


def main_text(html: str) -> str:
    tree = TreeBuilder()
    tree.feed(html)
    tree.close()
    drop_boilerplate(tree.nodes)
    blocks = score_tree(tree)
    if not blocks:
        return ""
    best = max((n for n in tree.nodes if n.size), key=lambda n: (score_of(n), -n.depth))
    score = score_of(best)
    if score <= 0:
        return ""
    best.kept = True
    beside = [x for x in best.parent.items if isinstance(x, Node) and x.size] if best.parent else []
    for x in beside:
        x.kept = x.kept or score_of(x) >= max(0.2 * score, 1) or x.tag in HEADINGS or x.tag in PARAGRAPHS and x.size > 80 and x.linked < x.size / 4
    between = [i for i, x in enumerate(beside) if x.kept]
    for x in beside[between[0]:between[-1]] if between else ():  # paragraphs between kept siblings stay, however short
        x.kept = x.kept or x.tag in PARAGRAPHS and x.linked < x.size / 2
    for node in tree.nodes:
        node.kept = node.kept or bool(node.parent and node.parent.kept)
    return " ".join(text for owner, text, _ in blocks if owner.kept)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "_main_text") -> DataFrame:
    """``pages`` with the main text of the whole html.

    A null or empty html gives the empty text, so does a page with nothing but boilerplate; broken
    markup is repaired as far as it goes; nesting of any depth takes time in proportion to the page;
    other columns pass unchanged, a column named like ``out`` is replaced; repeated rows appear
    each; an empty table gives no rows.
    """
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    return pages.withColumn(out, run(F.coalesce(F.col(html).cast("string"), F.lit(""))))
