"""Operator 4: main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes (chains of block elements with
their classes).  A node's presentation importance is the entropy of the child layouts that its
pages give it, its content importance one minus the entropy of each text's spread over the
pages: what stands on all pages alike says nothing.  A branch whose composite importance over
at least ``MIN_PAGES`` pages is below ``KEEP_FROM`` is noise on that host and is cut from each page.

Elements that say what they are (menus, footers, adverts, forms, comments ... by element, role or a
whole class or id) go without being put to the tree; but a form or a name on an element that holds
``main``, or most of the page's text with no ``article`` or ``main`` beside it, is a wrapper's and goes unheeded.
A name that stands in a part of a class or id only (``related-posts``, ``site-footer``, ``commentsArea``) is weaker evidence: it counts on
block elements, not beside a word that turns it round (``no-sidebar``, ``comments-open``), for everyday words only among
words of layout (``share-buttons``, but not ``share-price``), and not on what holds the page's article.  All other text is put to the tree, inside ``article`` and
``main`` and beside them; there a branch is noise only below ``OWN_KEEP_FROM``.  Pages of a host with
the same main texts count as one page, so that an article which is published many times is not
taken for a template.  A page's text is what the tree leaves, or all unnamed branches if it would
leave nothing.

Defined cases: null html is empty and gives an empty text; a null or unparsable URL puts the page on
the host ``""``; broken markup is read like a browser would (unclosed elements end with
their parents, a cut-off tag at the end goes); rows that repeat a page count as pages; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage, spread

MIN_PAGES = 5
KEEP_FROM = 0.3
#: For branches inside article or main.
OWN_KEEP_FROM = 0.1
#: Named elements in each other that are looked at.
NAMED_DEEP = 16
DECAY = 0.9
BROADCAST_BYTES = 32 << 20

_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*>))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_RAW = frozenset("script style textarea noscript template title iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody tfoot thead tr ul".split())
#: An opening tag ends the open elements of the first set, looking no further up than the second.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody"}, {"table"})}
_SHUTS_P = _BLOCK - {"head", "html", "body", "option", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
_P_SCOPE = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_NOISE_TAG = frozenset("nav footer aside script style noscript template button select textarea iframe svg canvas dialog menu head "
                       "object audio video search".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_NOISE_WORD = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination "
    "popup promo promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget widgets".split())
#: Words that name a page part within a longer name too ...
_HINT = frozenset(
    "ad ads adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter pager pagination popup sidebar signup sponsor sponsored "
    "subscribe toolbar".split())
#: ... and those that do if all words beside them are of layout, or such words themselves.
_WEAK_HINT = frozenset(
    "alert banner consent copyright header login notice promo promotion recommended related replies respond share sharing skip social "
    "widget widgets".split())
_LAYOUT = frozenset(
    "area articles bar block blocks bottom box buttons cards container content global group icons inner items left links list news "
    "panel posts reading right section site stories strip top wrap wrapper".split())
_TURNED = frozenset("no non not without with has have hide hidden off on open opened closed enabled disabled none".split())
_OWN = frozenset(("article", "main"))
_DIGITS = re.compile(r"\d+")
_NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


@lru_cache(maxsize=1 << 14)
def _names(value: str) -> tuple[bool, bool, bool, bool]:
    """Of a class or id: whether a whole word of it names a page part, and whether a part of a word hints at one; then both
    but for the word ``header``, which is an article's own inside it."""
    whole = set(value.lower().split()) & _NOISE_WORD
    hints = set()
    for name in value.split():
        parts = {p.lower() for p in _NAME_PART.findall(name)}
        if len(parts) > 1 and not parts & _TURNED:
            weak = parts & _WEAK_HINT
            hints |= parts & _HINT | (weak if parts <= _WEAK_HINT | _HINT | _LAYOUT else set())
    return bool(whole), bool(hints), bool(whole - {"header"}), bool(hints - {"header"})


class Block:
    __slots__ = ("path", "own", "named", "parts")

    def __init__(self, path: tuple[str, ...], own: bool, named: tuple[int, ...]):
        self.path, self.own, self.named, self.parts = path, own, named, []


def _noisy(tag: str, attrs: str, inside_own: bool) -> tuple[bool, bool, bool]:
    """Whether an element is noise whatever it holds, whether it is unless it is a wrapper, and whether a part of a name hints at it."""
    if tag in _NOISE_TAG or (tag == "header" and not inside_own):
        return True, False, False
    named, hinted = tag == "form", False
    if len(attrs) < 4 or tag in ("html", "body", "main"):
        return False, named, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            is_named, is_hinted = _names(value)[2:] if inside_own else _names(value)[:2]
            named, hinted = named or is_named, hinted or is_hinted and tag in _BLOCK
            continue
        value = value.lower()
        if (name == "role" and value in _NOISE_ROLE or name == "hidden" or name == "aria-hidden" and value == "true"
                or name == "style" and "display:none" in value.replace(" ", "")):
            return True, False, False
        if name == "role" and value == "form":
            named = True
    return False, named, hinted


def _wrappers(found: list[tuple[Block, str]], mains: set[int], hints: set[int]) -> set[int]:
    """Named elements, outer ones first, that hold ``main``, or most of the text with no article beside them; and
    of ``hints`` those around most of the articles' text, if no more text stands in no named element."""
    out = set(mains)
    total = sum(len(t) for _, t in found)
    if hints:
        own = sum(len(t) for b, t in found if b.own)
        held: Counter = Counter()
        for b, t in found:
            if b.own and hints.issuperset(b.named):  # not through comments or the like
                held.update(dict.fromkeys(b.named, len(t)))
        free = sum(len(t) for b, t in found if not b.named)
        out.update(i for i, n in held.items() if 2 * n >= own and n >= free)
    size: Counter = Counter()
    for b, t in found:
        size.update(dict.fromkeys(b.named, len(t)))
    for i in sorted(size):
        if i not in out and 2 * size[i] > total and not any(b.own and i not in b.named and out.issuperset(b.named) for b, _ in found):
            out.add(i)
    return out


def _style(tag: str, attrs: str) -> str:
    m = re.search(r"""\bclass\s*=\s*["']?([^"'>]*)""", attrs, re.I) if len(attrs) > 6 else None
    return tag + "." + _DIGITS.sub("#", " ".join(sorted(m[1].split()))) if m else tag


def blocks(html: str | None) -> list[tuple[tuple[str, ...], bool, str]]:
    """``(path of styles, inside article or main, text)`` of every block outside named noise, in page order."""
    html = html or ""
    out: list[Block] = []
    # Open elements: tag, style path of the blocks down to it, noise, inside article or main, named elements around it.
    stack: list[tuple[str, tuple[str, ...], bool, bool, tuple[int, ...]]] = [("", (), False, False, ())]
    n_named, mains, hints = 0, set(), set()
    current: Block | None = None
    end, at = html.rfind(">") + 1, 0

    def text(piece: str) -> None:
        nonlocal current
        if not piece or stack[-1][2]:
            return
        if current is None:
            current = Block(stack[-1][1], stack[-1][3], stack[-1][4])
            out.append(current)
        current.parts.append(piece)

    def close(tags, scope=()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    while at < end:
        m = _TAG.search(html, at, end)
        if not m:
            break
        text(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3][:-1]
        if m[1]:
            if tag in _BLOCK:
                current = None
            close((tag,), _P_SCOPE if tag == "p" else ("body", "html") if tag in _BLOCK else _BLOCK - {tag})
            continue
        if tag in _BLOCK:
            current = None
            if tag in _SHUTS_P:
                close(("p",), _P_SCOPE)
            if tag in _ENDS:
                close(*_ENDS[tag])
        elif tag in ("br", "td", "th"):
            text(" ")
        if tag in _RAW:
            stop = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
            if not stop:
                at = len(html)
                break
            at = stop.start()
            close_at = html.find(">", at)
            at = close_at + 1 if close_at >= 0 else len(html)
            continue
        if tag in _VOID or attrs.endswith("/"):
            continue
        _, path, noise, own, named = stack[-1]
        if tag in _BLOCK:
            path = path + (_style(tag, attrs),)
        if not noise:
            noise, is_named, is_hinted = _noisy(tag, attrs, own)
            is_hinted = is_hinted and not is_named and (tag != "article" or own or bool(named))
            if tag == "main":
                mains.update(named)
            # Beyond a few levels the outer elements' names decide.
            if (is_named or is_hinted) and len(named) < NAMED_DEEP:
                n_named += 1
                if is_hinted and not own and tag != "article":
                    hints.add(n_named)
                named = named + (n_named,)
        stack.append((tag, path, noise, own or tag in _OWN, named))
    tail = html[at:]
    cut = re.search(r"<[a-zA-Z/!?]", tail)  # a tag that the page breaks off in
    text(tail[:cut.start()] if cut else tail)
    found = [(b, t) for b in out if (t := " ".join(unescape("".join(b.parts)).split()))]
    wrappers = _wrappers(found, mains, hints) if n_named else set()
    return [(b.path, b.own, t) for b, t in found if wrappers.issuperset(b.named)]


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _node(path: tuple[str, ...]) -> str:
    return ">".join(path)


def _digest(found: list[tuple[tuple[str, ...], bool, str]]) -> int:
    """Hash of a page's main texts: those inside article or main if they are most of its text, else all."""
    own = [b[2] for b in found if b[1]]
    texts = own if 2 * sum(map(len, own)) > sum(len(b[2]) for b in found) else [b[2] for b in found]
    return xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages show of their host's nodes: ``(host, node, kind, value, digest)``, each once a batch; kind 0: pages with
    the node, 1: child layouts, 2: texts in the branch."""
    for b in batches:
        seen: dict = {}
        for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            host, found, layout, texts = host_of(url), blocks(html), {}, set()
            digest = _digest(found)
            for path, _, words in found:
                value = xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass")) - (1 << 63)
                for i in range(1, len(path) + 1):
                    node = _node(path[:i])
                    child = path[i] if i < len(path) else "#text"
                    kids = layout.setdefault(node, [])
                    if not kids or kids[-1] != child:
                        kids.append(child)
                    texts.add((node, value))
            for node, kids in layout.items():
                seen[host, node, 0, 0, digest] = None
                seen[host, node, 1, xxhash.xxh64_intdigest("|".join(kids).encode("utf-8", "surrogatepass")) - (1 << 63), digest] = None
            for node, value in texts:
                seen[host, node, 2, value, digest] = None
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int64()),
             pa.array([k[4] for k in keys], pa.int64())], names=["host", "node", "kind", "value", "digest"])


def importance(pages: DataFrame, decay: float = DECAY) -> DataFrame:
    """``(host, node, pages, presentation, content, importance)`` of every style node of every host."""
    src = spread(pages.select("url", "html"))
    seen = src.mapInArrow(_observations, "host string, node string, kind int, value long, digest long")
    # Pages with the same main texts are one page.
    seen = seen.distinct().groupBy("host", "node", "kind", "value").agg(F.count("*").alias("pages"))
    n = F.sum(F.when(F.col("kind") == 0, F.col("pages")))
    # With n pages: sum p log p over layouts, and log c of texts on c pages, each to base n.
    nodes = seen.groupBy("host", "node").agg(
        n.alias("pages"),
        F.sum(F.when(F.col("kind") == 1, F.col("pages") * F.log(F.col("pages").cast("double")))).alias("layouts"),
        F.avg(F.when(F.col("kind") == 2, F.log(F.col("pages").cast("double")))).alias("texts"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("kinds"))
    base = F.log(F.col("pages").cast("double"))
    nodes = nodes.withColumns({
        "presentation": F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(1 - F.col("layouts") / (F.col("pages") * base)),
        "content": F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("texts") / base))})
    share = F.pow(F.lit(decay), F.col("kinds").cast("double"))
    return nodes.select("host", "node", "pages", "presentation", "content",
                        ((1 - share) * F.col("presentation") + share * F.col("content")).alias("importance"))


def main_text(html: str | None, noise: list[str] | None) -> str:
    found = blocks(html)
    cut = set(noise or ())

    def stays(path: tuple[str, ...], own: bool) -> bool:
        nodes = [_node(path[:i]) for i in range(1, len(path) + 1)]
        return not any("!" + n in cut or not own and n in cut for n in nodes)

    kept = [b for b in found if stays(b[0], b[1])]
    return "\n\n".join(b[2] for b in kept or found)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, keep_from: float = KEEP_FROM,
            own_keep_from: float = OWN_KEEP_FROM) -> DataFrame:
    """``(page_id, url, text)`` of every row of ``pages (page_id, url, html)``."""
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    nodes = importance(src)
    low = nodes.where((F.col("pages") >= min_pages) & (F.col("importance") < keep_from))
    # "!" marks the nodes that are noise inside article and main as well.
    low = low.withColumn("node", F.when(F.col("importance") < own_keep_from, F.concat(F.lit("!"), "node")).otherwise(F.col("node")))
    # The names of style nodes, not of pages: a list per host as long as its page styles are many.
    low = cut_lineage(low.groupBy("host").agg(F.collect_list("node").alias("noise")), "sitetree-noise")
    size = low.agg(F.sum(F.octet_length(F.array_join("noise", " ")) + F.octet_length("host") + 32)).first()[0] or 0

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())],
                names=["page_id", "url", "html", "host"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h, n) for h, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())],
                                             names=["page_id", "url", "text"])

    ident = src.schema["page_id"].dataType.simpleString()
    placed = spread(src).mapInArrow(hosts, f"page_id {ident}, url string, html string, host string")
    placed = placed.join(F.broadcast(low) if size <= BROADCAST_BYTES else low, "host", "left")
    return placed.select("page_id", "url", "html", "noise").mapInArrow(texts, f"page_id {ident}, url string, text string")
