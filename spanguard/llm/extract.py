"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one for each block element). Menus, forms and the like are left out, and so are elements that
class or id call boilerplate, whatever their length, unless they enclose the main text. Lines that are mostly links weigh
nothing, others as many characters as they have outside links; a marked article adds a bounded bonus to its lines. The weights
are summed over sliding windows of lines: text surges where the sum does and dives where it falls to nothing.

A stretch found so is completed inside its parent block, where no dive counts: an article is kept from its first line to
its last, other blocks from the first heading, or line, to the last line, linked paragraphs between them included. Lists
of links end a stretch outside articles.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, functions as F

from spanguard.llm.worker import kept

WINDOW, SURGE, LINKED = 3, 60, 0.6
#: What a marked article adds to the weight of its lines: short ones surge together, not one alone.
BONUS = SURGE // WINDOW

# Elements without main text, elements that make a line of their own, words of names of boilerplate.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes")
DROPPED = ("head", "nav", "aside", "footer", "header", "form", "button", "select", "svg", "canvas", "object", "menu", "dialog", "audio", "video", "map", "datalist")
BLOCKS = (
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2",
    "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
BOILERPLATE = (
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promos", "promotion", "banner", "sidebar",
    "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related", "recommended",
    "recommendations", "widget", "toolbar", "pagination", "pager", "login", "signup", "copyright", "disclaimer", "paywall", "teaser", "outbrain", "taboola",
    "colophon", "siteinfo", "topbar", "skiplink",
)
COMMENTS = ("comment", "comments", "respond", "disqus", "commentlist", "replies", "discussion")
#: Words beside those above in names such as ``comment-list``; with any other word (``has-sidebar``) a name says nothing.
NEUTRAL = (
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list",
    "main", "outer", "panel", "posts", "articles", "primary", "right", "secondary", "section", "site", "slot", "text", "top", "unit", "widgets", "wrap", "wrapper",
)
# Elements that are the parent block of lines.
HOLDERS = ("article", "body", "center", "div", "fieldset", "html", "main", "section", "table", "td", "th")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

# Fixed values of HTML: elements whose start ends an open p or one of their own group, and those that shut such ends in.
ENDS_P = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
)
GROUP = {"p": "p", "li": "li", "dd": "dd", "dt": "dd", "td": "td", "th": "td", "tr": "tr", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody", "caption": "caption", "option": "option", "optgroup": "optgroup"}
ENDS_GROUP = {
    "li": ("li",), "dd": ("dd",), "dt": ("dd",), "option": ("option",), "optgroup": ("option", "optgroup"), "td": ("td", "caption"), "th": ("td", "caption"),
    "tr": ("tr", "caption"), "tbody": ("tbody", "caption"), "thead": ("tbody", "caption"), "tfoot": ("tbody", "caption"),
}
SCOPES = ("html", "table", "td", "th", "caption", "button", "object", "template", "select")
_ALL = tuple(dict.fromkeys(GROUP.values()))
SHUTS = {
    **{n: ("p", "li", "dd") for n in ("td", "th", "caption", "button", "object")}, "table": _ALL, "select": ("option", "optgroup"),
    "ul": ("li",), "ol": ("li",), "menu": ("li",), "dir": ("li",), "dl": ("dd",), **{n: ("li", "dd") for n in ("article", "section", "main", "aside", "blockquote", "form", "nav", "footer", "header", "fieldset", "figure", "details")},
}
TABLED = ("tr", "tbody", "thead", "tfoot")
HEADED = ("base", "link", "meta", "title", "style", "script", "noscript", "template")
FOREIGN = ("svg", "math")


def _compiled() -> dict:
    return {
        "tag": re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^\"'<>]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"),
        "start": re.compile(r"<(/?)([A-Za-z][^\s/><]*)"),
        "named": re.compile(r"(?:^|[\s\"'])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE),
        "role": re.compile(r"(?:^|[\s\"'])role\s*=\s*[\"']?([a-z]+)", re.IGNORECASE),
        "hidden": re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE),
        "number": re.compile(r"[0-9]+(?:x[0-9]+)?"),
        "rights": re.compile(r"(?:copyright\s*)?(?:©|\(c\))|copyright\s+(?:19|20)[0-9]{2}|all rights reserved[.]?$", re.IGNORECASE),
        "word": re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])"),
        "ends": {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW},
        "plates": frozenset(BOILERPLATE), "comments": frozenset(COMMENTS), "neutral": frozenset(NEUTRAL), "roles": frozenset(ROLES), "dropped": frozenset(DROPPED), "blocks": frozenset(BLOCKS) | frozenset(DROPPED),
        "raw": frozenset(RAW), "void": frozenset(VOID), "ends_p": frozenset(ENDS_P), "ends_group": ENDS_GROUP, "scopes": frozenset(SCOPES),
        "holders": frozenset(HOLDERS),
    }


def _named(name: str, attributes: str, rx: dict, in_article: bool) -> str:
    """What the class and id of an element call it: 'comments', 'plate' or nothing. A name counts whole, not by one of its words."""
    if not attributes.strip(" /") or name in ("body", "html", "main"):
        return ""
    found = ""
    for hit in rx["named"].finditer(attributes):
        for token in (hit[1] or hit[2] or hit[3] or "").split():
            words = [w.lower() for w in rx["word"].split(token) if w]
            if len(words) > 1 and (joined := "".join(words)) in rx["plates"] | rx["comments"]:
                words = [joined]
            own = [w for w in words if w in rx["plates"] or w in rx["comments"]]
            if own and all(w in rx["plates"] or w in rx["comments"] or w in rx["neutral"] or rx["number"].fullmatch(w) for w in words):
                if not rx["comments"].isdisjoint(own):
                    return "comments"
                found = "plate"
    return "" if name == "article" or name == "header" and in_article else found


def _skipped(name: str, attributes: str, rx: dict, in_article: bool) -> bool:
    """Whether an element is left out by its kind, its role or because it is hidden."""
    if attributes.strip(" /") and name not in ("body", "html", "main"):
        role = rx["role"].search(attributes)
        if role and role[1].lower() in rx["roles"] or rx["hidden"].search(attributes):
            return True
    return name in rx["dropped"] and not (name == "header" and in_article)


class _Mark:
    """An element with a name of boilerplate: what the name says, the named element around it, and what it encloses."""

    __slots__ = ("reason", "around", "within", "main", "title", "chars", "held", "gone")

    def __init__(self, reason: str, around: _Mark | None, within: bool):
        self.reason, self.around, self.within = reason, around, within  # within: a marked article encloses it
        self.main = self.title = self.gone = False
        self.chars = self.held = 0


class Line(NamedTuple):
    """A line and where it stands: its characters outside links (none if it is mostly links), and the elements around it."""

    text: str
    plain: int
    inside: bool  # in a marked article
    mark: _Mark | None  # innermost element with a name of boilerplate
    article: int  # number of the innermost article, 0 if none
    box: int  # number of the parent block, and of the one around it
    around: int
    title: bool  # in a heading of the first rank
    listed: bool  # in no paragraph


class _State:
    """What holds inside an open element; places in the stack of the nearest elements that later tags may close (-1: none)."""

    __slots__ = ("skip", "mark", "inside", "linked", "near", "block", "scope", "foreign", "article", "box", "around", "title")

    def __init__(self):
        self.skip = self.inside = self.linked = False
        self.mark: _Mark | None = None
        self.near: dict[str, int] = {}
        self.block = self.scope = self.foreign = -1
        self.article = self.box = self.around = 0
        self.title = False

    def inner(self) -> _State:
        new = object.__new__(_State)
        new.skip, new.mark, new.inside, new.linked, new.near = self.skip, self.mark, self.inside, self.linked, self.near
        new.block, new.scope, new.foreign = self.block, self.scope, self.foreign
        new.article, new.box, new.around, new.title = self.article, self.box, self.around, self.title
        return new


def lines(page: str) -> tuple[list[Line], list[_Mark]]:
    """Lines and named elements in page order. Reads the page once.

    Open elements are kept in a stack. End tags that HTML lets authors omit are supplied; what is skipped ends with its parent.
    """
    rx = kept("html", _compiled)
    out: list[Line] = []
    marks: list[_Mark] = []
    parts: list[str] = []
    linked = total = 0
    stack: list[tuple[str, _State]] = []  # names of open elements with the state around each
    places: dict[str, list[int]] = {}
    state = _State()
    at, size, boxes = 0, len(page), 0

    def put(text: str) -> None:
        nonlocal linked, total
        if text and not state.skip:
            text = html.unescape(text)
            parts.append(text)
            total += len(text)
            linked += len(text) * state.linked

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                share = linked / max(1, total)
                plain = 0 if share > LINKED else max(1, round(len(text) * (1 - share)))
                out.append(Line(text, plain, state.inside, state.mark, state.article, state.box, state.around, state.title, state.near.get("p", -1) < 0))
            parts.clear()
            linked = total = 0

    def close(place: int) -> None:
        nonlocal state
        while len(stack) > place:
            name, around = stack.pop()
            places[name].pop()
            if around.skip != state.skip or around.inside != state.inside or around.mark is not state.mark:
                flush()
            state = around

    def supply(name: str) -> None:
        """Ends that the start of an element implies."""
        if state.foreign >= 0 and name in rx["blocks"]:
            close(state.foreign)
        if stack and stack[-1][0] == "head" and name not in HEADED:
            close(len(stack) - 1)
        if name in rx["ends_p"] and state.near.get("p", -1) >= 0:
            close(state.near["p"])
        for group in rx["ends_group"].get(name, ()):
            if state.near.get(group, -1) >= 0:
                close(state.near[group])

    def push(name: str, inner: _State) -> None:
        nonlocal state, boxes
        place = len(stack)
        stack.append((name, state))
        places.setdefault(name, []).append(place)
        state = inner
        if name in rx["blocks"]:
            state.block = place
        if name in rx["scopes"]:
            state.scope = place
        if name in rx["holders"]:
            boxes += 1
            state.around, state.box = state.box, boxes
            if name == "article":
                state.article = boxes
        shut, group = SHUTS.get(name, ()), GROUP.get(name)
        if shut or group:
            state.near = {k: v for k, v in state.near.items() if k not in shut}
            if group:
                state.near[group] = place
        if name in FOREIGN:
            state.foreign = place
        elif name in ("foreignobject", "desc"):
            state.foreign = -1

    gone: set[str] = set()  # ends that no longer occur, looked for once
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            put(page[at:])
            break
        put(page[at:begin])
        if page.startswith("<!--", begin):
            end = -1 if "-->" in gone else page.find("-->", begin + 4)
            if end < 0:
                gone.add("-->")
                break
            at = end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        hit = rx["tag"].match(page, begin)
        if hit:
            at, closing, name, attributes = hit.end(), hit[1], hit[2].lower(), hit[3]
        else:
            hit = rx["start"].match(page, begin)
            if not hit:
                put("<")
                at = begin + 1
                continue
            end = page.find(">", hit.end())
            if end < 0:
                break
            at, closing, name, attributes = end + 1, hit[1], hit[2].lower(), page[hit.end() : end]
        if not closing and attributes.endswith("/") and (name in FOREIGN or state.foreign >= 0 and name not in rx["blocks"]):
            continue
        if not closing and name in rx["raw"]:
            end = rx["ends"][name].search(page, at) if name not in gone else None
            if not end:
                gone.add(name)
                break
            at = end.start()
            continue
        if name == "br":
            put(" ")
            continue
        if name in rx["blocks"]:
            flush()
        if closing:
            place = places[name][-1] if places.get(name) else -1
            if place >= 0 and (place >= state.scope or name in rx["scopes"] or name in TABLED) and (name in rx["blocks"] or place > state.block):
                close(place)
            elif name == "a":
                state.linked = False
            continue
        supply(name)
        if name in rx["void"]:
            continue
        inner = state.inner()
        if why := _named(name, attributes, rx, state.inside):
            flush()
            marks.append(_Mark(why, state.mark, state.inside))
            inner.mark = marks[-1]
        if _skipped(name, attributes, rx, state.inside):
            flush()
            inner.skip = True
        elif name in ("article", "main"):
            inner.skip, inner.inside = False, True
            if state.mark and name == "main":
                state.mark.main = True
        elif name == "h1":
            inner.title = True
            if state.mark:
                state.mark.title = True
        elif name == "a":
            inner.linked = True
        push(name, inner)
    flush()
    return out, marks


def _left_out(found: list[Line], marks: list[_Mark]) -> None:
    """Marks the named elements whose lines go, whatever their length.

    A name is not believed where its element encloses the main text: ``main``, most text of articles (comments may hold articles
    of their own), the title and most text, or all but a few characters of the page.
    """
    for line in found:
        if line.mark:
            line.mark.chars += line.plain
            line.mark.held += line.plain * line.inside
    for mark in reversed(marks):
        if around := mark.around:
            around.chars += mark.chars
            around.held += mark.held
            around.main, around.title = around.main or mark.main, around.title or mark.title
    total, held = sum(line.plain for line in found), sum(line.plain for line in found if line.inside)
    for mark in marks:
        rest = total - mark.chars
        elsewhere = held and 2 * mark.held <= held  # most text of articles
        encloses = mark.main or not elsewhere and rest < (1 if mark.within else SURGE) and 4 * rest < mark.chars
        if mark.reason == "plate":
            encloses = encloses or not mark.within and 2 * mark.held > held or mark.title and 4 * rest < mark.chars
        mark.gone = not encloses or bool(mark.around and mark.around.gone)


def _weights(found: list[Line]) -> list[int]:
    """Characters outside links, and more in a marked article.

    Where most text is in marked articles, lines outside weigh up to ``SURGE`` characters less; where little is, nothing changes.
    """
    total, marked = sum(line.plain for line in found), sum(line.plain for line in found if line.inside)
    malus = round(SURGE * max(0, 2 * marked - total) / max(1, total))
    return [(line.plain and line.plain + BONUS) if line.inside else max(0, line.plain - malus) for line in found]


def stretches(weights: list[int]) -> list[bool]:
    """Which lines weigh and stand between a surge of the sliding sum and its dive; the heaviest window if it surges nowhere."""
    sums, total = [], sum(weights[:WINDOW])
    for place in range(len(weights)):
        sums.append(total)
        total += (weights[place + WINDOW] if place + WINDOW < len(weights) else 0) - weights[place]
    core, inside = [], False
    for weight, ahead in zip(weights, sums):
        if not inside and weight and ahead >= SURGE:
            inside = True
        elif inside and not ahead:
            inside = False
        core.append(bool(inside and weight))
    if not any(core) and (best := max(sums, default=0)):
        place = sums.index(best)
        core = [place <= i < place + WINDOW and weight > 0 for i, weight in enumerate(weights)]
    return core


def _completed(found: list[Line], core: list[bool]) -> list[bool]:
    """The stretches with what belongs to them in their parent blocks."""
    keep, size = list(core), len(found)
    articles: dict[int, list[int]] = {}
    lined = Counter(line.box for line in found)
    parents = []
    for place, line in enumerate(found):
        if line.article:
            articles.setdefault(line.article, []).append(place)
        parents.append(-line.article if line.article else line.box if lined[line.box] > 1 else line.around)
    for places in articles.values():
        if any(core[i] for i in places):
            worded = [i for i in places if found[i].plain]
            for i in places:
                keep[i] = keep[i] or worded[0] <= i <= worded[-1]
    first = 0
    while first < size:  # outside articles: neighbouring lines of one parent block, parted where three links or more stand in a list
        last, links = first, 0
        while last < size and parents[last] == parents[first]:
            links = links + 1 if not found[last].plain and found[last].listed else 0
            last += 1
            if links == WINDOW:
                break
        own = range(first, last)
        inner = [i for i in own if core[i]]
        if inner and parents[first] >= 0:
            worded = [i for i in own if found[i].plain]
            titles = [i for i in worded if found[i].title and i <= inner[0]]
            for i in range((titles or worded)[0], worded[-1] + 1):
                keep[i] = True
        first = last
    # Linked paragraphs between two kept lines of one stretch whose blocks differ.
    before = -1
    for i in range(size):
        if keep[i]:
            if before >= 0 and 0 < i - before - 1 < WINDOW and not any(found[j].plain for j in range(before + 1, i)):
                keep[before + 1 : i] = [True] * (i - before - 1)
            before = i
    return keep


def main_text(page: str | None) -> str:
    """The kept lines joined by line ends; empty for null, empty and textless pages."""
    found, marks = lines(page) if page else ([], [])
    _left_out(found, marks)
    found = [line for line in found if not (line.mark and line.mark.gone)]  # an advert between paragraphs parts no windows
    kept_lines = [line for line, keep in zip(found, _completed(found, stretches(_weights(found)))) if keep]
    rights = kept("html", _compiled)["rights"]
    while kept_lines and not kept_lines[-1].inside and len(kept_lines) > 1 and rights.match(kept_lines[-1].text):
        kept_lines.pop()
    return "\n".join(line.text for line in kept_lines)


def extracted(page: Column) -> Column:
    """The main text of each page; empty for null, empty and textless pages, whole pages of any length, each row alone."""

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return text(page)
