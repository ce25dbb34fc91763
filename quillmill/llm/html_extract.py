"""Main-text extraction by tree scoring.

A tolerant parser builds the element tree (implied end tags, unclosed and stray tags, raw-text elements). Elements that
never hold an article, by tag, role or the words of their class and id, are cut. Each paragraph then passes points for
its length and commas to its ancestors, full to the parent and less further up; an ancestor's sum is discounted by its
link density. The best container is kept, with siblings that score well beside it, and its blocks are the text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import tidy

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Fixed values of HTML: elements without content, with raw text, that make blocks, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "thead": {"tr", "td", "th"}}
STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "option": {"select"}}
# Elements, roles and words of class or id that mark what is never the article.
CUT = frozenset("script style noscript template textarea title head iframe object embed svg math canvas audio video nav aside footer form button select option datalist input menu dialog search noembed noframes xmp".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar topbar cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal share sharing comment comments commenting disqus pagination pager toolbar outbrain taboola paywall".split())
# Words that name furniture as well as what prose is about; they need a second sign.
WEAK = frozenset("banner promotion rail footer foot masthead header notice notices alert overlay social related recommend recommended recommendations reply replies respond discussion feedback widget skip copyright legal disclaimer".split())
BAD = STRONG | WEAK
# Weak words of what stands at an edge of an article; words that say nothing beside a weak one; elements
# that a reader fills in; titles of lists that lead elsewhere.
EDGE = frozenset("notice notices alert banner overlay skip copyright disclaimer footer foot reply replies respond feedback widget".split())
PLAIN = frozenset("area bar block box col column container content div group inner item items link links list outer post posts row section site the wrap wrapper".split())
CONTROLS = frozenset("form input button select textarea".split())
TITLES = re.compile(r"\s*(?:related|read (?:more|next|also)|more (?:from|on|stories|articles|posts)|recommended|share|follow us|tags?\b|popular|trending|most read|latest|you (?:may|might)|comments?\b|newsletter|navigation|menu)", re.I)
GOOD = frozenset("article articles content entry main page post story text body blog hentry prose markdown".split())
WEIGHT = {"article": 25, "main": 20, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "address": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
PARAGRAPH = frozenset("p pre td blockquote div section article main body li dd".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "points", "text", "linked", "links", "asks")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []
        self.points = 0.0
        self.text = self.linked = self.links = 0
        self.asks = False

    def attr(self) -> dict[str, str]:
        return {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(self.attrs)}

    def words(self, a: dict[str, str]) -> set[str]:
        return {w.lower() for w in _WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")}


def parse(html: str) -> Node:
    root = at = Node("#root", "", None)
    pos = 0
    while True:
        m = _TOKEN.search(html, pos)
        if m is None:
            break
        if m.start() > pos:
            at.kids.append(html[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            n = at
            while n is not root and n.tag != tag:
                n = n.up
            if n is not root:
                at = n.up
            elif tag == "p":
                at.kids.append(Node("p", "", at))
            continue
        if tag in BLOCK:
            n = at  # a block ends an open paragraph, unless a container was opened inside it
            while n is not root and n.tag != "p" and (n.tag not in BLOCK):
                n = n.up
            if n.tag == "p":
                at = n.up
        if tag in SAME:
            n = at
            while n is not root and n.tag not in STOP[tag]:
                if n.tag in SAME[tag]:
                    at = n.up
                n = n.up
        node = Node(tag, m[3] or "", at)
        at.kids.append(node)
        if tag in VOID or (m[3] and m[3].endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:  # names in RAW are plain letters
            end = re.compile(f"</{tag}", re.I).search(html, pos)
            if end is None:
                break  # as browsers do: raw text runs to the end
            pos = html.find(">", end.end())
            if pos < 0:
                break
            pos += 1
            continue
        at = node
    if m is None and pos < len(html):
        at.kids.append(html[pos:])
    return root


def measure(nodes: list[Node]) -> None:
    """Characters, linked ones, links and whether a reader fills in anything, below each node; ``nodes`` are in order."""
    for n in reversed(nodes):  # children first
        n.text, n.linked, n.links, n.asks = 0, 0, int(n.tag == "a"), n.tag in CONTROLS
        for k in n.kids:
            if isinstance(k, str):
                n.text += len(k) - k.count(" ") - k.count("\n")
            else:
                n.text += k.text
                n.linked += k.text if k.tag == "a" else k.linked
                n.links += k.links
                n.asks |= k.asks


def at_an_edge(n: Node) -> bool:
    """Whether nothing but white space lies before or behind ``n`` in its parent."""
    some = [k for k in n.up.kids if k is n or (k.strip() if isinstance(k, str) else k.text)]
    return some[0] is n or some[-1] is n


def unwanted(n: Node, inside: bool, by_class: bool) -> bool:
    """Whether ``n`` is cut. Names that mean furniture alone decide; others need a second sign: many links, something to
    fill in, or that the names say nothing else and the element lies outside an article or at an edge of it. ``inside`` an
    article, its own header stays, and so do paragraphs and headings that only a weak name marks."""
    if n.tag in CUT or (n.tag == "header" and not inside):
        return True
    if not n.attrs:
        return False
    a = n.attr()
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if n.tag in ("html", "body", "article", "main"):
        return n.tag == "article" and by_class and bool(n.words(a) & {"comment", "comments", "ad", "ads", "advert", "promo", "related", "sponsored"})
    if a.get("role", "") in CUT_ROLES:
        return True
    words = n.words(a)
    if not by_class or n.tag in ("a", "b", "i", "em", "strong", "span"):
        return False
    if words & STRONG:
        return True
    weak = words & WEAK
    if not weak or (inside and n.tag in ("p", "header", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote")):
        return False
    if n.asks or (n.links > 1 and n.linked > 0.4 * n.text):
        return True
    return words <= BAD | PLAIN and (not inside or bool(weak & EDGE) and at_an_edge(n))


def prune(root: Node, by_class: bool) -> None:
    measure(in_order(root))
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag in ("article", "main")
        n.kids = [k for k in n.kids if isinstance(k, str) or not unwanted(k, inside, by_class)]
        stack += [(k, inside) for k in n.kids if not isinstance(k, str)]


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n.kids) if not isinstance(k, str)]
    return out


def inline_text(n: Node) -> str:
    """Text of ``n`` outside its block children."""
    out, stack = [], list(reversed(n.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append(" ")
        elif k.tag not in BLOCK:
            stack += reversed(k.kids)
    return _SPACE.sub(" ", "".join(out)).strip()


def score(nodes: list[Node]) -> None:
    measure(nodes)
    for n in nodes:
        n.points += WEIGHT.get(n.tag, 0)
        if n.attrs and n.tag in BLOCK:
            w = n.words(n.attr())
            n.points += 25 * bool(w & GOOD) - 25 * bool(w & BAD)
    for n in nodes:
        if n.tag not in PARAGRAPH:
            continue
        t = inline_text(n)
        if not t:
            continue
        points = (1 + sum(map(t.count, ",，、،")) + min(len(t) / 100, 3)) * (1 - n.linked / max(1, n.text)) * min(1, len(t) / 25)
        up, share = (n if n.tag not in ("p", "pre", "td", "blockquote", "li", "dd") else n.up), 1.0
        for depth in range(4):
            if up is None or up.tag == "#root":
                break
            up.points += points * share
            up, share = up.up, 0.5 if depth == 0 else 1 / (3 * (depth + 1))


def final(n: Node) -> float:
    return n.points * (1 - n.linked / max(1, n.text)) if n.points > 0 else n.points


def choose(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container and the siblings to keep with it, in page order."""
    can = [n for n in nodes if n.text and n.tag in BLOCK and n.tag not in ("html", "p", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol")]
    if not can:
        return [root]
    best = max(can, key=final)  # ties: the outermost, first in order
    if best.up is None or best.tag in ("article", "main", "body"):
        return [best]
    bar = max(10.0, 0.2 * final(best))
    out = []
    for k in best.up.kids:
        if k is best:
            out.append(k)
        elif not isinstance(k, str) and k.text:
            dense = k.linked / k.text
            if (k.points > 0 and k.tag in BLOCK and final(k) >= bar) or (k.tag == "p" and ((k.text > 80 and dense < 0.25) or (k.linked == 0 and inline_text(k)[-1:] in (".", "!", "?", "…")))) or (k.tag in ("h1", "h2", "h3") and best not in out and dense < 0.25) or part_of_article(k):
                out.append(k)
    return out


def part_of_article(n: Node) -> bool:
    """A container beside the best one that has a heading of its own and sentences under it."""
    if n.tag not in ("div", "section") or n.linked > 0.25 * n.text:
        return False
    below = in_order(n)
    heads = [k for k in below if k.tag in ("h1", "h2", "h3", "h4") and k.text]
    told = [k for k in below if k.tag in ("p", "blockquote", "li") and inline_text(k)[-1:] in (".", "!", "?", "…", ":", "\"", "”")]
    return bool(heads and told) and not TITLES.match(inline_text(heads[0]))


def linky(n: Node) -> bool:
    """A list or container that is mostly several links, unless it stands under a heading of the article, or behind a
    sentence that announces it."""
    if n.tag not in ("ul", "ol", "div", "section", "table", "dl") or not n.text or n.links < 2 or n.linked <= 0.6 * n.text:
        return False
    inner = next((k for k in in_order(n)[1:] if k.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and k.text), None)
    if inner is not None and inner.linked == 0:
        return bool(TITLES.match(inline_text(inner)))
    before = None
    for k in n.up.kids:
        if k is n:
            break
        if not isinstance(k, str) and k.text:
            before = k
    if before is None or before.linked:
        return True
    if before.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return before.tag == "h1" or bool(TITLES.match(inline_text(before)))
    return not inline_text(before).endswith(":")


def blocks(tops: list[Node]) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        t = _SPACE.sub(" ", unescape("".join(now)).replace("\0", "")).strip()
        now.clear()
        if t:
            out.append(t)

    for top in tops:
        stack: list[Node | str | None] = [top]
        while stack:
            k = stack.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                now.append(k)
            elif k.tag == "br":
                now.append(" ")
            elif k is not top and k.linked and linky(k):
                flush()
            else:
                if k.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(k.kids)
        flush()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks joined by blank lines; empty for null, empty or textless pages."""
    if not html:
        return ""
    for by_class in (True, False):  # a page whose every container carries a suspect name is read without names
        root = parse(html)
        prune(root, by_class)
        nodes = in_order(root)
        score(nodes)
        text = "\n\n".join(blocks(choose(root, nodes)))
        if text:
            return text
    return ""


def _extract(batches):
    for b in batches:
        text = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string())], names=["id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)``, one row per page. Null and empty pages, and pages without text, give an empty text;
    ids and urls may be null or repeated, and each row is read by itself; of containers that tie the outermost, then the
    first, is taken; pages of any length and nesting of any depth are read whole; an empty table gives no rows; extra
    columns are ignored."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(tidy(_extract), "id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
