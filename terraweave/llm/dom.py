"""A small tolerant HTML parser: elements with their parents, text runs, and features of elements as arrays."""

from __future__ import annotations

import html
import re

import numpy as np

_TAG = re.compile(r"""<(?:!--(?:(?:.*?)-->|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>|[a-zA-Z/!?][^>]*\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")

# Element names of the HTML standard by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg canvas object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an open paragraph does not outlive.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: For an element, those of the same list or table that it closes, and what bounds the search.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role that authors give to parts of a page.
MARKS = {
    "content": "article body content entry main post story text".split(),
    "menu": "breadcrumb breadcrumbs menu menubar nav navbar navigation pagination pager tabs toc".split(),
    "head": "banner header masthead top topbar".split(),
    "foot": "bottom colophon copyright foot footer legal".split(),
    "side": "aside related recommended rail sidebar widget".split(),
    "advert": "ad ads advert advertisement banner promo promoted promotion sponsor sponsored".split(),
    "notice": "alert consent cookie cookies gdpr modal notice overlay popup privacy".split(),
    "form": "form login newsletter search signup subscribe".split(),
    "comment": "comment comments discussion disqus feedback replies reply respond".split(),
    "share": "share sharing social".split(),
}
_MARK_OF = {w: k for k, words in enumerate(MARKS.values()) for w in words}
GROUPS = ["p", "heading", "div", "section", "article", "main", "nav", "header", "footer", "aside", "list", "item", "form", "table", "quote", "link", "inline", "figure", "other"]
_GROUP = {"p": 0, **dict.fromkeys(HEADINGS, 1), "div": 2, "section": 3, "article": 4, "main": 5, "nav": 6, "header": 7, "footer": 8, "aside": 9, **dict.fromkeys(("ul", "ol", "dl", "menu"), 10), **dict.fromkeys(("li", "dt", "dd"), 11), **dict.fromkeys(("form", "input", "button", "select", "option", "fieldset", "label"), 12), **dict.fromkeys(("table", "tr", "td", "th", "tbody", "thead", "caption"), 13), **dict.fromkeys(("blockquote", "pre"), 14), "a": 15, **dict.fromkeys(("figure", "figcaption", "picture"), 17)}


class Page:
    """Elements in page order: tag, parent (-1: none), and the text runs of each; order: (element, text) of all runs."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.marks, self.hidden = ["#page"], [-1], [frozenset()], [False]
        self.runs: list[tuple[int, str]] = []
        source = source or ""
        stack, at, skip = [0], 0, ""
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            name = (m[2] or m[5] or "").lower()
            closing = bool(m[1] or m[4])
            if skip:
                if closing and name == skip:
                    skip, at = "", m.end()
                continue
            if m.start() > at:
                self.runs.append((stack[-1], source[at : m.start()]))
            at = m.end()
            if not name:
                continue
            if closing:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name), 0)
                if depth:
                    del stack[depth:]
                continue
            if name in ENDS_P:
                self._close(stack, {"p"}, {"td", "th", "button", "table"})
            if name in SIBLINGS:
                self._close(stack, *SIBLINGS[name])
            attributes = m[3] or m[6] or ""
            if name in RAW or name == "title":
                if not attributes.rstrip().endswith("/"):
                    skip = name
                continue
            if name == "br" or name == "wbr":
                self.runs.append((stack[-1], " " if name == "br" else ""))
                continue
            self.tag.append(name)
            self.parent.append(stack[-1])
            found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
            words = set(_TOKEN.findall(" ".join(found.get(k, "") for k in ("class", "id", "role"))))
            self.marks.append(frozenset(_MARK_OF[w] for w in words if w in _MARK_OF))
            self.hidden.append("hidden" in found or "display:none" in found.get("style", "").replace(" ", ""))
            if name not in VOID:
                stack.append(len(self.tag) - 1)
        if not skip and at < len(source):
            self.runs.append((stack[-1], source[at:]))
        self.runs = [(e, html.unescape(t)) for e, t in self.runs]

    def _close(self, stack: list[int], names: set[str], bounds: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in names:
                del stack[k:]
                return
            if self.tag[stack[k]] in bounds:
                return

    def own(self) -> np.ndarray:
        """Code points of the text runs of each element."""
        n = np.zeros(len(self.tag))
        for e, text in self.runs:
            n[e] += len(text.strip())
        return n

    def blocks(self, kept: np.ndarray | list[bool]) -> list[str]:
        """Texts of blocks, white space folded, of runs whose element is kept; inline elements belong to their block."""
        block_of = list(range(len(self.tag)))
        for k in range(1, len(self.tag)):
            if self.tag[k] in INLINE:
                block_of[k] = block_of[self.parent[k]]
        out: list[list[str]] = []
        last = None
        for e, text in self.runs:
            if not kept[e]:
                continue
            if block_of[e] != last:
                out.append([])
                last = block_of[e]
            out[-1].append(text)
        return [t for t in (" ".join("".join(parts).split()) for parts in out) if t]


FEATURES = [*(f"is_{g}" for g in GROUPS), *(f"has_{m}" for m in MARKS), *(f"under_{m}" for m in MARKS), "within_nav", "within_footer", "within_aside", "within_form", "within_article", "depth", "place", "siblings", "like_siblings", "children", "elements", "text", "text_share", "own_text", "link_share", "punctuation", "words_a_run", "parent_link_share", "before", "hidden", "prior_text", "next_text"]


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    n = len(page.tag)
    parent = np.array(page.parent)
    x = np.zeros((n, len(FEATURES)), np.float32)
    col = {f: k for k, f in enumerate(FEATURES)}
    own, links, stops, runs, first = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
    in_link = [False] * n
    so_far = 0
    group = [(_GROUP.get(t, 16 if t in INLINE else 18)) for t in page.tag]
    for k in range(1, n):
        in_link[k] = page.tag[k] == "a" or in_link[parent[k]]
    for e, text in page.runs:
        size = len(text.strip())
        if not size:
            continue
        own[e] += size
        runs[e] += 1
        stops[e] += sum(map(text.count, ".,;:!?"))
        if in_link[e]:
            links[e] += size
        if first[e] < 0:
            first[e] = so_far
        so_far += size
    text, link, stop, run, count, kids = own.copy(), links.copy(), stops.copy(), runs.copy(), np.ones(n), np.zeros(n)
    begin = np.where(first < 0, np.inf, first)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        text[p] += text[k]
        link[p] += link[k]
        stop[p] += stop[k]
        run[p] += run[k]
        count[p] += count[k]
        kids[p] += 1
        begin[p] = min(begin[p], begin[k])
    under = np.zeros((n, len(MARKS) + 5), bool)
    tags = {"nav": 0, "footer": 1, "aside": 2, "form": 3, "article": 4}
    seen: dict[int, list[int]] = {}
    for k in range(n):
        x[k, group[k]] = 1
        for m in page.marks[k]:
            x[k, col["has_content"] + m] = 1
        if k:
            p = parent[k]
            under[k] = under[p]
            for m in page.marks[p]:
                under[k, m] = True
            if page.tag[p] in tags:
                under[k, len(MARKS) + tags[page.tag[p]]] = True
            x[k, col["depth"]] = x[p, col["depth"]] + 1
            seen.setdefault(p, []).append(k)
    x[:, col["under_content"] : col["under_content"] + under.shape[1]] = under
    share = link / np.maximum(text, 1)
    for p, those in seen.items():
        kinds = [page.tag[k] for k in those]
        for at, k in enumerate(those):
            x[k, col["place"]] = at / len(those)
            x[k, col["siblings"]] = len(those)
            x[k, col["like_siblings"]] = kinds.count(kinds[at]) / len(those)
            x[k, col["parent_link_share"]] = share[p]
            x[k, col["prior_text"]] = np.log1p(text[those[at - 1]]) if at else 0
            x[k, col["next_text"]] = np.log1p(text[those[at + 1]]) if at + 1 < len(those) else 0
    total = max(text[0], 1)
    for name, v in (("children", np.log1p(kids)), ("elements", np.log1p(count)), ("text", np.log1p(text)), ("text_share", text / total), ("own_text", np.log1p(own)), ("link_share", share), ("punctuation", stop / np.maximum(text, 1)), ("words_a_run", np.log1p(text / np.maximum(run, 1))), ("before", np.where(np.isinf(begin), 1, begin / total)), ("hidden", page.hidden)):
        x[:, col[name]] = v
    return x
