"""Main text of web pages by wrappers inferred from the pages of each host.

A page's token stream of tags and texts is read into nested blocks; inline tags
vanish, texts become slots. A wrapper is a regular expression without unions
over such blocks: for each path of blocks a cardinality, once, optional or
repeated, the repeated groups of neighbours that it belongs to, and a text slot
that is one constant or variable. Pages of one host are aligned path by path:
blocks of equal path match, a path that some holders lack becomes optional, one
that a holder has more than once repeated, paths that alternate under a holder
one repeated group, and texts that differ a variable slot. All of these are sums,
least and greatest values, so wrappers don't depend on the order of pages: each
task folds its pages, and one aggregation by host and path folds the tasks. A
host with a third of all pages is one small set of rows per task. A wrapper's
size depends on a host's templates, not on its number of pages: paths that a
single page of several has align with nothing and are left out.

Wrappers say where a host's article is, and what in it is template: blocks whose
whole text is the same on all pages, as long as most of the article varies.
Where no element is named as the article, it is the smallest block that holds
most of the text that varies and is no link; there, constant blocks and repeated
groups of links are template whatever they are called. A page that lacks its
host's places is judged by its own structure. Tags, roles and class names that
say what a block is are read on the page itself.

Paths are 64-bit hashes of parent and key, and all walks use explicit stacks, so
depth is no limit and a page costs time in proportion to its length.

Defined results: a null html is an empty text; markup that is cut off ends
where the page ends; pages without a host (null url, no ``://``) form a host of
their own; repeated rows get equal texts; empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import pick, stored
from sievework.llm.url_filters import host_of

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)|[^<]+|<""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements whose content is text up to their end tag.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe"])
#: Elements without content.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
#: Elements that don't end a block of text.
INLINE = frozenset(
    [
        "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
        "math", "mfrac", "mi", "mn", "mo", "mrow", "ms", "msqrt", "msub", "msup", "mtext", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
        "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    ]
)
#: Elements that never hold main text.
DROPPED = frozenset(
    [
        "script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas", "audio", "video", "object", "nav", "footer",
        "aside", "form", "button", "select", "option", "dialog", "menu", "head", "applet", "map", "datalist",
    ]
)
#: An open paragraph ends before these.
ENDS_PARAGRAPH = frozenset(
    [
        "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
        "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
    ]
)
#: An open element ends before another of the same group, up to the given containers.
ENDS_SAME = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
#: End tags of these don't close anything outside the innermost article, main or body.
INNER = frozenset(["p", "li", "td", "tr", "div", "section"])
BARRIERS = frozenset(["article", "main", "body"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Class names and ids, or the last words of their compounds, that mark what is no article text.
MARKS = frozenset(
    [
        "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "promoted",
        "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "sidenav", "rail", "aside", "footer",
        "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal",
        "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended",
        "recommendations", "trending", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "widget", "skip",
        "skiplink", "hidden", "copyright", "tags", "tagcloud", "byline", "toc", "search", "paywall", "donate", "disclaimer",
    ]
)
#: Words that say where or how a block is laid out: the word before them is what counts.
FRAMES = frozenset(
    [
        "wrap", "wrapper", "container", "box", "inner", "outer", "section", "area", "block", "list", "item", "items", "slot", "unit", "bar", "panel",
        "content", "links", "posts", "articles", "stories", "form", "top", "bottom", "left", "right", "primary", "secondary", "main", "text",
        "message", "buttons", "icons", "link", "group", "region", "column", "col", "row", "body",
    ]
)
#: Words of class and id that mark the article.
CONTENT = frozenset(["article", "content", "post", "entry", "story", "main", "body", "maintext", "articlebody"])
ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"])
SHAPED = frozenset(["div", "section", "main", "article", "header", "table", "ul", "ol"])
DESCENDED = frozenset(["div", "section", "body", "html", "table", "tbody", "tr", "td", "center"])
_BODYLIKE = frozenset(["html", "body", "#root"])


class Block:
    """A block of a page: tag, key, left out with all inside or not, its pieces (texts and blocks, in order), characters in links."""

    __slots__ = ("tag", "key", "drop", "pieces", "link", "holds")

    def __init__(self, tag: str, key: str, drop: bool) -> None:
        self.tag, self.key, self.drop = tag, key, drop
        self.pieces: list = []
        self.link = 0
        self.holds = False  # an article

    def inner(self) -> list[Block]:
        return [p for p in self.pieces if isinstance(p, Block) and not p.drop]


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]


def marked(name: str) -> str | None:
    """The mark that one class name or id is, or ends in: ``site-footer`` and ``comment-list`` are marked, ``hidden-gem`` is not."""
    words = _words(name)
    while words and words[-1] in FRAMES:
        words.pop()
    if words and words[-1] in MARKS:
        return words[-1]
    return "header" if words and words[-1] == "header" else None


def _describe(tag: str, raw: str, in_article: bool) -> tuple[str, bool]:
    """A block's key, and whether its tag or attributes say that it is no main text."""
    drop = tag in DROPPED or (tag == "header" and not in_article)  # within an article its headings stay
    if not raw or raw.isspace():
        return tag, drop
    attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    marks = {m for m in map(marked, names) if m}
    if tag not in _BODYLIKE and tag not in BARRIERS:
        drop = drop or bool(marks - {"header"}) or ("header" in marks and not in_article)
    elif tag == "article":
        drop = drop or bool(marks & {"comment", "comments", "ad", "advert", "related", "reply"})
    drop = drop or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
    drop = drop or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    shape = ".".join(sorted({w for n in names for w in _words(n)})) if tag in SHAPED else ""
    return (f"{tag}.{shape}" if shape else tag), drop


class _Open:
    """The open blocks of a page, with the places of each tag, so that no end tag searches the stack."""

    def __init__(self, root: Block) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.barriers = [0]
        self.articles = 0

    def push(self, block: Block) -> None:
        at = len(self.stack)
        self.stack.append(block)
        self.places.setdefault(block.tag, []).append(at)
        if block.tag in BARRIERS:
            self.barriers.append(at)
            self.articles += block.tag != "body"

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            block = self.stack.pop()
            self.places[block.tag].pop()
            if block.tag in BARRIERS:
                self.barriers.pop()
                self.articles -= block.tag != "body"

    def close(self, tag: str) -> None:
        at = self.last(tag)
        if at and (tag not in INNER or at > self.barriers[-1]):
            self.cut(at)

    def hold_article(self) -> None:
        """What holds an article is no sidebar or form, whatever it is called."""
        for block in reversed(self.stack):
            if block.holds:
                break
            block.holds = True
            block.drop = block.tag in ("nav", "aside", "footer")


def read_blocks(html: str) -> Block:
    """The blocks of a page. Never fails: what can't be understood is text or ignored."""
    root = Block("#root", "#root", False)
    opened = _Open(root)
    links = 0
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        top = opened.stack[-1]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                top.pieces.append(token)
                if links:
                    top.link += len(token)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                top.pieces.append(" ")
            elif tag not in INLINE:
                opened.close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        closed = m[3].rstrip().endswith("/")
        if tag in INLINE:
            if tag == "a" and not closed:
                links += 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                top.pieces.append(" ")
            continue
        if tag in ENDS_PARAGRAPH and top.tag == "p":
            opened.cut(len(opened.stack) - 1)
        if tag in ENDS_SAME:
            same, around = ENDS_SAME[tag]
            own = opened.last(*same)
            if own > opened.last(*around):
                opened.cut(own)
        key, drop = _describe(tag, m[3], opened.articles > 0)
        block = Block(tag, key, drop)
        if tag in ("article", "main") and not drop:
            opened.hold_article()
        opened.stack[-1].pieces.append(block)
        if not closed or tag not in ("p", "div"):
            opened.push(block)
    return root


# --- wrappers


def _number(*parts: bytes) -> int:
    """A signed 64-bit number for byte strings."""
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "big", signed=True)


def path_under(parent: int, key: str) -> int:
    """The path of a block with ``key`` within ``parent``."""
    return _number(parent.to_bytes(8, "big", signed=True), key.encode("utf-8", "surrogatepass"))


#: The path of a page's root.
ROOT = 0


@dataclass
class Slot:
    """One path of a wrapper. Sums, least and greatest values: slots of equal path add up in any order."""

    parent: int
    key: str
    #: Pages that have the path, blocks on it, blocks of its parent that hold it, most that one of these holds.
    pages: int
    blocks: int
    holders: int
    most: int
    #: Characters of the blocks with all inside, and those of them in links.
    chars: int
    links: int
    #: Least and greatest hash of the pages' own texts, and of their texts with all inside.
    text_low: int
    text_high: int
    whole_low: int
    whole_high: int
    #: Sum of the places among the siblings at which it first stands, and the least key that it alternates with.
    place: int
    group: str | None

    def add(self, other: Slot) -> None:
        self.pages += other.pages
        self.blocks += other.blocks
        self.holders += other.holders
        self.most = max(self.most, other.most)
        self.chars += other.chars
        self.links += other.links
        self.text_low, self.text_high = min(self.text_low, other.text_low), max(self.text_high, other.text_high)
        self.whole_low, self.whole_high = min(self.whole_low, other.whole_low), max(self.whole_high, other.whole_high)
        self.place += other.place
        self.group = min((g for g in (self.group, other.group) if g is not None), default=None)

    @property
    def constant(self) -> bool:
        """Whether all pages have one text on this path, all inside included."""
        return self.whole_low == self.whole_high


Wrapper = dict[int, Slot]


def _alternating(paths: list[int]) -> dict[int, set[int]]:
    """Of the paths of one block's children, in order: those between whose first and last place others stand, with these."""
    first, last = {}, {}
    for at, path in enumerate(paths):
        first.setdefault(path, at)
        last[path] = at
    out: dict[int, set[int]] = {}
    run: list[int] = []
    end = -1
    for path in [*sorted(first, key=first.__getitem__), None]:
        if path is None or first[path] > end:
            if len(run) > 1:
                out.update({p: set(run) for p in run})
            run = []
        if path is not None:
            run.append(path)
            end = max(end, last[path])
    return out


#: Hash of a path without text.
_NOTHING = _number(b"")


def wrapper_of(root: Block) -> Wrapper:
    """The wrapper of one page. Dropped blocks are left out."""
    blocks, paths, inside = [root], [ROOT], []  # holders before what they hold; places of the inner blocks
    memo: dict[tuple[int, str], int] = {}
    at = 0
    while at < len(blocks):
        inner = blocks[at].inner()
        inside.append(range(len(blocks), len(blocks) + len(inner)))
        for b in inner:
            path = memo.get((paths[at], b.key))
            if path is None:
                path = memo[paths[at], b.key] = path_under(paths[at], b.key)
            blocks.append(b)
            paths.append(path)
        at += 1
    texts, wholes, chars, links = [b""] * at, [b""] * at, [0] * at, [0] * at
    for i in range(at - 1, -1, -1):
        text = " ".join("".join(p for p in blocks[i].pieces if isinstance(p, str)).split())
        texts[i] = text.encode("utf-8", "surrogatepass")
        chars[i] = len(text) + sum(chars[k] for k in inside[i])
        links[i] = min(blocks[i].link, len(text)) + sum(links[k] for k in inside[i])
        wholes[i] = blake2b(b"\0".join([texts[i], *(wholes[k] for k in inside[i])]), digest_size=8).digest()
    out: Wrapper = {ROOT: Slot(ROOT, "#root", 1, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, None)}
    for i in range(at):
        times: dict[int, int] = {}
        for k in inside[i]:
            times[paths[k]] = times.get(paths[k], 0) + 1
        groups = _alternating([paths[k] for k in inside[i]]) if len(times) > 1 else {}
        key_of = {paths[k]: blocks[k].key for k in inside[i]}
        for place, (path, n) in enumerate(times.items()):
            group = min((key_of[p] for p in groups[path]), default=None) if path in groups else None
            more = Slot(paths[i], key_of[path], 1, 0, 1, n, 0, 0, 0, 0, 0, 0, place, group)
            if path in out:
                out[path].add(more)
                out[path].pages = 1
            else:
                out[path] = more
    own: dict[int, list[bytes]] = {}
    whole: dict[int, list[bytes]] = {}
    for i in sorted(range(at), key=lambda i: paths[i]):
        slot = out[paths[i]]
        slot.blocks += 1
        slot.chars += chars[i]
        slot.links += links[i]
        own.setdefault(paths[i], []).append(texts[i])
        whole.setdefault(paths[i], []).append(wholes[i])
    for path, slot in out.items():
        slot.text_low = slot.text_high = _NOTHING if not any(own[path]) else _number(*own[path])
        slot.whole_low = slot.whole_high = _number(*whole[path])
    return out


def merge(into: Wrapper, other: Wrapper) -> Wrapper:
    """``into``, aligned with ``other``."""
    for path, slot in other.items():
        if path in into:
            into[path].add(slot)
        else:
            into[path] = replace(slot)
    return into


def _inside(wrapper: Wrapper) -> dict[int, list[int]]:
    """The paths under each path, in page order."""
    out: dict[int, list[int]] = {}
    for path, slot in wrapper.items():
        if path != ROOT:
            out.setdefault(slot.parent, []).append(path)
    for paths in out.values():
        paths.sort(key=lambda p: (wrapper[p].place / wrapper[p].holders, wrapper[p].key))
    return out


def expression(wrapper: Wrapper) -> str:
    """A wrapper as a regular expression without unions: ``?`` optional, ``+`` repeated, ``{=}`` constant and ``{}`` variable text."""
    inside = _inside(wrapper)
    out: list[str] = []
    work: list = [ROOT]
    while work:
        step = work.pop()
        if isinstance(step, str):
            out.append(step)
            continue
        slot = wrapper[step]
        text = "" if slot.text_low == slot.text_high == _NOTHING else "{=}" if slot.text_low == slot.text_high else "{}"
        parent = wrapper[slot.parent]
        mark = ("+" if slot.most > 1 and slot.group is None else "") + ("?" if slot.holders < parent.blocks and step != ROOT else "")
        steps: list = [f"<{slot.key}>{text}"]
        previous = None
        for path in inside.get(step, []):
            group = wrapper[path].group
            if group != previous:
                steps += [")+"] * (previous is not None) + ["("] * (group is not None)
            previous = group
            steps.append(path)
        steps += [")+"] * (previous is not None) + [f"</{slot.key.partition('.')[0]}>{mark}"]
        work.extend(reversed(steps))
    return "".join(out)


def _rank(key: str) -> int:
    tag, _, shape = key.partition(".")
    return 3 if tag == "article" else 2 if tag == "main" else 1 if tag in ("div", "section") and CONTENT & set(shape.split(".")) else 0


def _outermost(paths: Iterable[int], wrapper: Wrapper) -> list[int]:
    chosen = set(paths)
    out = []
    under: dict[int, bool] = {ROOT: False}  # whether something above a path is chosen
    for path in paths:
        trail = [path]
        while trail[-1] not in under:
            parent = wrapper[trail[-1]].parent
            if parent not in wrapper:
                under[trail[-1]] = False
                break
            trail.append(parent)
        for p in reversed(trail):
            if p not in under:
                under[p] = under[wrapper[p].parent] or wrapper[p].parent in chosen
        if not under[path]:
            out.append(path)
    return out


def main_places(wrapper: Wrapper) -> tuple[list[int], bool]:
    """The paths that hold the article, and whether an element or name says so."""
    inside = _inside(wrapper)
    order = [ROOT]
    for path in order:
        order.extend(inside.get(path, []))
    total = max(1, wrapper[ROOT].chars)
    for rank in (3, 2, 1):
        own = [p for p in order if _rank(wrapper[p].key) == rank and wrapper[p].chars and 2 * wrapper[p].links <= wrapper[p].chars]
        if rank == 1:
            own = [p for p in own if 5 * wrapper[p].chars >= total]
        own = _outermost(own, wrapper)
        single = [p for p in own if wrapper[p].most == 1]
        if single:  # short blocks that come repeatedly beside a single one are a list of other articles
            least = max(wrapper[p].chars / wrapper[p].blocks for p in single) / 2
            own = [p for p in own if wrapper[p].most == 1 or wrapper[p].chars / wrapper[p].blocks >= least]
        if own:
            return own, True
    own = {p: wrapper[p].chars - wrapper[p].links for p in order}
    varying = dict(own)  # characters that differ between pages and are in no link
    for path in reversed(order):
        varying[path] -= sum(own[p] - varying[p] for p in inside.get(path, []))
        if wrapper[path].constant and wrapper[path].pages > 1:
            varying[path] = 0
    here = ROOT
    while inside.get(here):  # down to the smallest block with most of them
        best = max(inside[here], key=varying.__getitem__)
        if wrapper[best].most > 1 or wrapper[best].key.partition(".")[0] not in DESCENDED or varying[best] < 0.8 * max(1, varying[ROOT]):
            break
        here = best
    return [here], False


def template_paths(wrapper: Wrapper, place: int, named: bool) -> list[int]:
    """Paths within the article that are template.

    Within a named article: blocks with a class whose text all its pages share,
    if these hold less than half of it; else the article itself is what pages
    share. Elsewhere: such blocks without a class too, and repeated links.
    """
    inside = _inside(wrapper)
    holder = wrapper[place]
    constant, menus = [], []
    work = [place]
    while work:
        for path in inside.get(work.pop(), []):
            slot = wrapper[path]
            if holder.pages > 1 and slot.constant and slot.pages == holder.pages and slot.chars and ("." in slot.key or not named):
                constant.append(path)
            elif not named and 5 * slot.links > 4 * slot.chars and any(wrapper[p].most > 1 for p in inside.get(path, [])):
                menus.append(path)
            else:
                work.append(path)
    if holder.constant or 2 * sum(wrapper[p].chars for p in constant) >= holder.chars:
        constant = []
    return constant + menus


def rules_of(wrapper: Wrapper) -> dict:
    """What extraction needs of a host's wrapper: the paths of the article and of template within it."""
    places, named = main_places(wrapper)
    return {"places": places, "template": [p for place in places for p in template_paths(wrapper, place, named)]}


def text_at(root: Block, rules: dict) -> str | None:
    """The kept text at the places of ``rules``: references decoded, white space single, trimmed. None if no place is there."""
    places, template = frozenset(rules["places"]), frozenset(rules["template"])
    memo: dict[tuple[int, str], int] = {}
    out: list[str] = []
    found = ROOT in places
    work: list = [(root, 0, ROOT, found, False)]
    while work:
        block, at, path, kept, headings = work.pop()
        while at < len(block.pieces):
            piece = block.pieces[at]
            at += 1
            if isinstance(piece, str):
                if kept and (not headings or block.tag in HEADINGS):
                    out.append(piece)
                continue
            out.append(" ")
            if piece.drop:
                continue
            below = memo.get((path, piece.key))
            if below is None:
                below = memo[path, piece.key] = path_under(path, piece.key)
            if below in template:
                continue
            work.append((block, at, path, kept, headings))
            kept = kept or below in places
            found = found or kept
            headings = (headings and piece.tag not in HEADINGS) or piece.tag == "header"
            block, at, path = piece, 0, below
        out.append(" ")
    return " ".join(unescape("".join(out)).split()) if found else None


def extract(html: str | None, rules: dict | None) -> str:
    """The main text of a page by its host's rules; without them, or if their places are missing, by its own structure."""
    if not html:
        return ""
    root = read_blocks(html)
    text = text_at(root, rules) if rules else None
    if text is None:
        text = text_at(root, rules_of(wrapper_of(root)))
    return text or ""


# --- in Spark

#: Slots that a task holds before it hands them on.
HELD_SLOTS = 200_000
_NUMBERS = ["pages", "blocks", "holders", "most", "chars", "links", "text_low", "text_high", "whole_low", "whole_high", "place"]
WRAPPER = "host string, path long, parent long, key string, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", `group` string"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The aligned slots of each host's pages in this task."""
    held: dict[str, Wrapper] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, path, slot) for host, wrapper in held.items() for path, slot in wrapper.items()]
        held.clear()
        own = {
            "host": pa.array([h for h, _, _ in rows], pa.string()),
            "path": pa.array([p for _, p, _ in rows], pa.int64()),
            "parent": pa.array([s.parent for _, _, s in rows], pa.int64()),
            "key": pa.array([s.key for _, _, s in rows], pa.string()),
        }
        own |= {n: pa.array([getattr(s, n) for _, _, s in rows], pa.int64()) for n in _NUMBERS}
        own["group"] = pa.array([s.group for _, _, s in rows], pa.string())
        return pa.RecordBatch.from_pydict(own)

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html:
                merge(held.setdefault(host, {}), wrapper_of(read_blocks(html)))
        if sum(map(len, held.values())) > HELD_SLOTS:
            yield out()
    yield out()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """The wrapper of each host of the pages (url, html): one row per path, with the columns of ``Slot``."""
    rows = pick(pages, url="url", html="html").select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    least, sums = ("text_low", "whole_low", "group"), ("pages", "blocks", "holders", "chars", "links", "place")
    slots = rows.mapInArrow(_slots, WRAPPER).groupBy("host", "path")
    return slots.agg(
        *[F.min(n).alias(n) for n in ("parent", "key", *least)],
        *[F.sum(n).alias(n) for n in sums],
        *[F.max(n).alias(n) for n in ("most", "text_high", "whole_high")],
    )


def wrapper_from(table: pa.Table) -> Wrapper:
    """The wrapper of one host's rows."""
    names = ["parent", "key", *_NUMBERS, "group"]
    columns = [table[n].to_pylist() for n in names]
    return {path: Slot(*values) for path, *values in zip(table["path"].to_pylist(), *columns, strict=True)}


def _rules(table: pa.Table) -> pa.Table:
    return pa.table({"host": [table["host"][0].as_py()], "rules": [json.dumps(rules_of(wrapper_from(table)))]})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, dict | None] = {None: None}
    for batch in batches:
        texts = []
        for html, rules in zip(batch.column("html").to_pylist(), batch.column("rules").to_pylist(), strict=True):
            if rules not in known:
                if len(known) > 10_000:
                    known = {None: None}
                known[rules] = json.loads(rules)
            texts.append(extract(html, known[rules]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_rules(pages: DataFrame) -> DataFrame:
    """(host, rules as JSON) of the pages (url, html)."""
    wrappers = infer_wrappers(pages)
    all_pages = F.max("pages").over(Window.partitionBy("host"))
    aligned = wrappers.withColumn("__all", all_pages).filter("pages > 1 OR __all = 1").drop("__all")
    return aligned.groupBy("host").applyInArrow(_rules, "host string, rules string")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page (page_id, url, html), by the wrapper of its host.

    The rules, one small row per host, are a stored table: Spark broadcasts
    them only below its size limit, and else joins by host, splitting a hot one.
    """
    rules = stored(host_rules(pages), "wrappers")
    rows = pick(pages, page_id="page_id", url="url", html="html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    known = rows.withColumn("host", host_of(F.col("url"))).join(rules, "host", "left").select("page_id", "url", "html", "rules")
    return known.mapInArrow(_extract, "page_id long, url string, text string")
