"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with its root-to-leaf path of tags and
classes. Per path, the text length and the punctuation are aggregated over its blocks, links counted a quarter (length
ratio, punctuation ratio); along the page both are smoothed. A path's own ratio, weighted by the kind of its element,
is fused with the best ratio of the families around it (the blocks that stand directly in an element above, less with
every plain wrapper between) as a geometric mean. Features of structure multiply the fused ratio: parts that their
tag or role makes menus, footers, forms and the like count nothing, parts with an aside's name and parts beside the
container little. The container is the article or main element that holds enough content, else the smallest element
that holds nearly all. Blocks whose path reaches the threshold, which follows from the page's mean ratio, are the
result. A name counts nothing on an element that is or holds the article or most of the content, nor a name of two
meanings on a part of the article that is not mostly links.

Null html, empty pages and pages without content give the empty text. Unclosed and stray tags do no harm; time grows
with the length of a page, however deep its tags lie. Of containers with equal content the deepest counts. Repeated
rows give repeated results, an empty table gives none; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame

from twinlake.llm.common import map_arrow, need

# Fixed values of HTML: elements that end a line of text, that have no end tag, whose content is no markup, and that
# end an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select"
    " summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ENDS_P = BLOCK - frozenset("button caption body head html option optgroup select td th tr tbody thead tfoot title template textarea iframe noscript legend".split())
#: An opening tag ends an open element of the same kind, unless one of the others stands between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Elements and roles that hold no article text.
ASIDE_TAGS = frozenset("head nav footer aside form button select textarea input label noscript template iframe svg dialog menu script style object canvas audio video search fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of class and id names of parts that are not the article.
ASIDE_WORDS = frozenset(
    "ad ads adsbygoogle adslot advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright"
    " disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager"
    " pagination popup promo promoted promotion recommended recommendations related replies reply respond share sharing side sidebar signup"
    " skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
#: Those of them that also name parts of an article.
EITHER_WORDS = frozenset("discussion recommended recommendations related replies reply respond teaser work".split())
CONTAINERS = frozenset("html body main article section div td center".split())
#: What a text of this kind of element counts against one that stands in a plain element; boxes are often no content.
KINDS = dict.fromkeys("h1 h2 h3 h4 h5 h6 li dd dt td th caption figcaption pre".split(), 12.0) | dict.fromkeys(("p", "blockquote"), 4.0) | {"div": 0.4}
#: Elements that structure a text: what stands in them belongs with what stands around them.
CLEAR = frozenset("ul ol dl table thead tbody tfoot tr figure section blockquote hgroup header details".split())
WRAPPED, LINKED, NAMED, BESIDE, OUTSIDE, LEAST = 0.2, 0.25, 0.02, 0.02, 0.3, 2.0

# a quotation mark opens a value only where a value begins
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"']))|[^>=])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*+=\s*+(?:\"([^\"]*)|'([^']*)|([^\s>\"'][^\s>]*))[\"']?)?")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟،]")
_SCOPE = frozenset(("button", "td", "th", "table", "object"))


class Element:
    """An element with what it takes over from those above it; `path` is the number of its tag path."""

    __slots__ = ("tag", "path", "parent", "depth", "block", "aside", "in_article", "in_link", "named", "mute", "mute_named", "open", "held", "linked", "weight")

    def __init__(self, tag: str, parent: Element | None, attributes: str, paths: dict, index: int):
        self.tag, self.parent = tag, parent
        self.held = self.linked = 0.0
        self.weight = 1.0
        found: dict[str, str] = {}
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name in _READ:
                    found.setdefault(name, m[2] or m[3] or m[4] or "")
        classes = found.get("class", "").lower().split()
        step = tag + "".join(f".{c}" for c in sorted(classes))
        self.path = paths.setdefault((parent.path if parent else -1, step), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.in_link = tag == "a" or parent is not None and parent.in_link and self.block is not self
        words = {w.lower() for n in ("class", "id") if n in found for w in _NAME_WORD.findall(found[n])}
        aside = words & ASIDE_WORDS | ({"header"} if "header" in words and tag == "div" and not self.in_article else set())
        self.named = 0 if not aside or tag in ("html", "body", "main") else 1 if aside <= EITHER_WORDS else 2
        if self.named == 2 and not (aside - EITHER_WORDS).isdisjoint([*classes, found.get("id", "").lower()]):
            self.named = 3  # the whole of a class or id, not a word of one
        self.aside = (
            (parent is not None and parent.aside)
            or tag in ASIDE_TAGS
            or tag == "header" and not self.in_article
            or found.get("role", "").lower() in ASIDE_ROLES
            or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
        )
        # inline parts such as hidden spans and buttons are no text of the block around them
        inline = self.block is not self
        self.mute = inline and not self.block.aside and (parent.mute or self.aside)
        self.mute_named = inline and not self.block.aside and (parent.mute_named or self.aside or self.named > 0)
        # stack places of what an opening tag may end: an open paragraph, and of each kind of sibling the outermost
        p, *kinds = parent.open if parent else (0, *[0] * len(SIBLINGS))
        p = 0 if tag in _SCOPE else index if tag == "p" else p
        self.open = (p, *[0 if tag in edge else k or (index if tag in same else 0) for k, (same, edge) in zip(kinds, SIBLINGS.values(), strict=True)])


class Block:
    __slots__ = ("element", "text", "length", "linked", "marks", "score", "plain")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.length, self.linked = element, text, len(text), min(linked, len(text))
        self.marks = len(_PUNCTUATION.findall(text))
        self.score = self.plain = 0.0


_KIND = {tag: i + 1 for i, tag in enumerate(SIBLINGS)}


def blocks(html: str, names: bool = True) -> tuple[list[Block], list[Element]]:
    """The page's blocks of text and its elements, in order; text of inline parts named as asides only without `names`."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("html", None, "", paths, 0)
    stack, out, made = [root], [], [root]
    opened: dict[str, int] = {}
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append(Block(stack[-1].block, text, linked))
            buffer.clear()
        linked = 0

    def close(i: int) -> None:
        if any(e.tag in BLOCK for e in stack[i:]):
            flush()
        for e in stack[max(i, 1) :]:
            opened[e.tag] -= 1
        del stack[max(i, 1) :]

    def data(s: str) -> None:
        nonlocal linked
        if s:
            top = stack[-1]
            if top.mute_named if names else top.mute:
                return
            s = entities.unescape(s) if "&" in s else s
            buffer.append(s)
            if top.in_link or link_above(top):
                linked += len(s)

    def link_above(e: Element) -> bool:
        return opened.get("a", 0) > 0 and e.block is e

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            data(html[at:])
            break
        data(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                buffer.append(" ")
            if not opened.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end tag ends nothing beyond its block
            continue
        if tag == "html" or tag == "body" and opened.get("body"):
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                buffer.append(" " if tag == "br" else "")
            continue
        if tag in ENDS_P and (i := stack[-1].open[0]):
            close(i)
        if tag in _KIND and (i := stack[-1].open[_KIND[tag]]):
            close(i)
        if tag == "body" and opened.get("head"):
            close(next(i for i, e in enumerate(stack) if e.tag == "head"))
        if tag in BLOCK:
            flush()
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else size
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        stack.append(Element(tag, stack[-1], m[3], paths, len(stack)))
        made.append(stack[-1])
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out, made


def scores(found: list[Block], made: list[Element]) -> float:
    """Sets each block's fused path ratio, by element weights; returns the threshold of content."""
    length = [b.length - (1 - LINKED) * b.linked for b in found]
    marks = [b.marks * (1 - (1 - LINKED) * b.linked / b.length) for b in found]

    def smooth(x: list[float]) -> list[float]:
        return [(x[max(i - 1, 0)] + 10 * v + x[min(i + 1, len(x) - 1)]) / 12 for i, v in enumerate(x)]

    def ratios(keys: list, *columns: list[float]) -> dict:
        per: dict = {}
        for k, *row in zip(keys, *columns, strict=True):
            n = per.setdefault(k, [0, 0.0, 0.0])
            n[0] += 1
            n[1] += row[0]
            n[2] += row[1]
        return {k: math.sqrt(t / n * (m / n + 0.1)) for k, (n, t, m) in per.items()}

    length, marks = smooth(length), smooth(marks)
    own = ratios([b.element.path for b in found], length, marks)
    family = ratios([(b.element.parent or b.element).path for b in found], length, marks)
    # the best family around each element, from the root down; what stands in the page's body is no family of its parts
    around: dict[Element, float] = {}
    for e in made:
        above = around[e.parent] * (1.0 if e.tag in CLEAR else WRAPPED) if e.parent else 0.0
        around[e] = max(above, family.get(e.path, 0.0)) if e.tag not in ("html", "body") else 0.0
    total = mean = 0.0
    for b in found:
        e = b.element
        support = max(around[e.parent or e], family[(e.parent or e).path])
        b.plain = math.sqrt(own[e.path] * support)
        b.score = b.plain * math.sqrt(KINDS.get(e.tag, 1.0)) * e.weight
        if not e.aside:
            total += b.length
            mean += b.length * b.plain
    mean = mean / total if total else 0.0
    return min(LEAST * math.sqrt(mean), mean / 2)


def hold(found: list[Block], made: list[Element], threshold: float) -> float:
    """Sets what content, and what links, each element holds; returns all the content."""
    for e in made:
        e.held = e.linked = 0.0
    for b in found:
        b.element.held += (b.length - b.linked) + 1e-6 if b.score >= threshold and not b.element.aside else 0.0
        b.element.linked += b.linked
    for e in reversed(made):
        if e.parent:
            e.parent.held += e.held
            e.parent.linked += e.linked
    return made[0].held


def below(made: list[Element], tops: set[Element]) -> set[Element]:
    """The tops and all elements under them."""
    out: set[Element] = set()
    for e in made:
        if e in tops or e.parent in out:
            out.add(e)
    return out


def main_article(made: list[Element], total: float) -> Element | None:
    """The greatest outermost article, or else main, that holds three tenths of the content."""
    for tag in ("article", "main"):
        inner = below(made, {e for e in made if e.tag == tag})
        best = max((e for e in made if e.tag == tag and not e.aside and e.parent not in inner), key=lambda e: e.held, default=None)
        if best is not None and best.held > 0 and best.held >= 0.3 * total:
            return best
    return None


def weigh_names(made: list[Element], total: float) -> None:
    """Lowers the weight of parts with an aside's name, by what content these hold."""
    article = main_article(made, total)
    inside = below(made, {article}) if article else set()
    holders = {article, *_above(article)} if article else set()
    under_name = below(made, {e for e in made if e.named})
    # an article of any size, below no such name, is enough against a part that is wholly named an aside
    lone = any(e.tag == "article" and e.held > 0 and e not in under_name for e in made)
    for e in made:
        if e.parent:
            e.weight = e.parent.weight
        if not e.named or e in holders:
            continue
        within = e in inside
        most = (within or article is None and not (lone and e.named == 3)) and e.held >= 0.5 * (article.held if within else total)
        if not most and not (e.named == 1 and within and e.linked <= 0.3 * (e.held + e.linked)):
            e.weight *= NAMED


def weigh_container(found: list[Block], made: list[Element], total: float) -> None:
    """Lowers the weight of what stands beside the container."""
    best = main_article(made, total)
    if best is None:
        best = max((e for e in made if e.tag in CONTAINERS and not e.aside and e.held >= 0.85 * total), key=lambda e: e.depth, default=None)
    if best is None:
        return
    inside = below(made, {best})
    if best.tag != "article":
        # a headline may stand beside the element that holds the text
        line = {best.parent, *_above(best.parent)} if best.parent else set()
        first = next((i for i, b in enumerate(found) if b.element in inside), 0)
        inside |= set([b.element for b in found[:first] if b.element.tag == "h1" and b.element.parent in line][-1:])
    for e in made:
        if e not in inside:
            e.weight *= BESIDE if best.tag == "article" else OUTSIDE


def selected(found: list[Block], made: list[Element], least: float | None = None) -> list[Block]:
    """The blocks whose path's score reaches the threshold (`least`, where it is given)."""
    for e in made:
        e.weight = 0.0 if e.aside else 1.0
    total = hold(found, made, scores(found, made))
    weigh_names(made, total)
    for e in made:
        e.weight = 0.0 if e.aside else e.weight
    total = hold(found, made, scores(found, made))
    weigh_container(found, made, total)
    threshold = scores(found, made)
    return [b for b in found if b.score >= (threshold if least is None else least) and (least is not None or b.score > 0)]


def extract(html: str | None, least: float | None = None) -> str:
    """The main text: content blocks joined by line ends. `least` replaces the page's own threshold."""
    for names in (True, False):
        found, made = blocks(html or "", names)
        if any(not b.element.aside for b in found):
            return "\n".join(b.text for b in selected(found, made, least))
        if not html:
            break
    return ""


def _above(e: Element) -> list[Element]:
    out = []
    while e.parent:
        e = e.parent
        out.append(e)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        text = [extract(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_arrow(need(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", 1024)
