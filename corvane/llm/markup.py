"""Markup residue in text documents: which languages a body carries, and its clean text."""

from __future__ import annotations

import html
import html.entities
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

LANGUAGES = ("html", "markdown", "wiki", "latex")

#: Element names, and commands that need no argument to be recognised.
TAGS = "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
BARE_COMMANDS = "item documentclass usepackage maketitle tableofcontents newpage clearpage noindent centering hline ldots dots par newline linebreak bigskip medskip smallskip footnotesize bibliography appendix today LaTeX TeX"
WIKI_TAGS = "nowiki syntaxhighlight ref references gallery poem"

_names = lambda s: "|".join(sorted(s.split(), key=len, reverse=True))
TAG = re.compile(rf"</?(?:{_names(TAGS)})(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<!DOCTYPE[^>]*>", re.I)
WIKI_TAG = re.compile(rf"</?(?:{_names(WIKI_TAGS)})(?=[\s/>])[^<>]*>", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
FENCE = re.compile(r"(?ms)^[ ]{0,3}(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)")
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\n[ \t]*\n).)+?)(?<!`)\1(?!`)", re.S)
HTML_CODE = re.compile(r"<(pre|code|script|style|xmp|textarea|samp|kbd)(?=[\s>])[^<>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)(?=[\s>])[^<>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
LATEX_CODE = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(.*?)(?:\\end\{\1\}|\Z)|\\(?:verb|lstinline)\*?([^\s\w{*])([^\n]*?)\3", re.S)
MATH = re.compile(r"\$\$(?!\s*\$)(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\d$\w])", re.S)
COMMAND = re.compile(rf"\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{|(?:{_names(BARE_COMMANDS)})(?![A-Za-z])|begin\b|end\b)")

#: Marks of Markdown and of wikis that no other language here has.
MARKDOWN = [
    re.compile(p, re.M)
    for p in (
        r"^[ ]{1,3}#{2,6}[ \t]+\S",
        r"^(?=[^\n]*[^\s=\-|])[ ]{0,3}[^\s#>*+|=\-][^\n]*\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$",
        r"^[ ]{0,3}(?:[-+]|\d{1,4}[.)])[ \t]+\S",
        r"^[ ]{0,3}>[ \t]?\S",
        r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$",
        r"^[ ]{0,3}\|.*\|[ \t]*\n[ ]{0,3}\|?[ \t]*:?-{2,}",
        r"^[ ]{0,3}\|[ \t]*:?-{3,}:?[ \t]*\|",
        r"!?\[[^\[\]\n]*\]\([^()\s]*(?:\([^()\s]*\))?[^()\s]*(?:\s+\"[^\"\n]*\")?\)",
        r"!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]",
        r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]+\S",
        r"(?<![\w*\\])\*\*(?=[^\s*])(?:(?!\n[ \t]*\n)[^*])+?(?<=\S)\*\*(?![\w*])",
        r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])",
        r"(?<![\w\\])__(?=[^\s_])(?:(?!\n[ \t]*\n).)+?(?<=[^\s_])__(?!\w)",
        r"(?<![\w\\])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?!\w)",
        r"~~(?=\S)[^~\n]+?(?<=\S)~~",
        r"<(?:https?|ftp|mailto):[^<>\s]+>",
    )
]
WIKI = [
    re.compile(p, re.M)
    for p in (
        r"\[\[(?=[^\[\]\n])[^\[\]\n]*\]\]",
        r"\{\{(?=[^{}\n])[^{}]*\}\}",
        r"(?<!')'{2,3}(?=[^'\s])[^'\n]*(?:'[^'\n]+)*?(?<=\S)'{2,3}(?!')",
        r"^={1,6}[ \t]*[^=\s\n](?:[^\n]*[^=\s\n])?[ \t]*={1,6}[ \t]*$",
        r"\[(?:https?|ftp|mailto):[^\[\]\s]+(?:[ \t][^\[\]\n]*)?\](?!\()",
        r"^\{\|",
        r"__(?:NO)?TOC__|#REDIRECT",
        r"~{4}",
    )
]
#: A Markdown heading or a nested list item of a wiki.
DEEP = re.compile(r"^#{2,6}[ \t]+\S", re.M)
SHARED = re.compile(r"^(?:\*+|#+)[ \t]+\S|^-{4,}[ \t]*$", re.M)
PLACE = re.compile("\ue000(\\d+)\ue001")
WIKI_INDENTED = re.compile(r"(?m)^ (?=\S).*(?:\n .*)*")


#: For each of MARKDOWN and WIKI signs of which a text with such a mark has one.
MARKDOWN_SIGNS = ["#", "= -", "- + . )", ">", "* _", "|", "|", "](", "][", "]:", "**", "*", "__", "_", "~~", "<"]
WIKI_SIGNS = ["[[", "{{", "''", "=", "[http [ftp [mailto", "{|", "__ #REDIRECT", "~~~~"]
MARKDOWN = [(p, signs.split()) for p, signs in zip(MARKDOWN, MARKDOWN_SIGNS, strict=True)]
WIKI = [(p, signs.split()) for p, signs in zip(WIKI, WIKI_SIGNS, strict=True)]


def _spans(patterns: list, text: str) -> list[tuple[int, int]]:
    return [m.span() for p, signs in patterns if any(map(text.__contains__, signs)) for m in p.finditer(text)]


class Flow:
    """Minimum cut by Dinic's maximum flow, for two labels."""

    def __init__(self, n: int) -> None:
        self.s, self.t, self.out = n, n + 1, [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def source_side(self) -> list[bool]:
        """Which nodes stay with the source after the cut."""
        while True:
            depth = [-1] * len(self.out)
            depth[self.s], queue = 0, deque([self.s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.cap[e] > 1e-9 and depth[self.to[e]] < 0:
                        depth[self.to[e]] = depth[a] + 1
                        queue.append(self.to[e])
            if depth[self.t] < 0:
                return [d >= 0 for d in depth[: self.s]]
            at, path, a = [0] * len(self.out), [], self.s
            while True:
                if a == self.t:
                    least = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                    path, a = [], self.s
                    continue
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if self.cap[e] > 1e-9 and depth[self.to[e]] == depth[a] + 1:
                        path.append(e)
                        a = self.to[e]
                        break
                    at[a] += 1
                else:
                    if a == self.s:
                        break
                    depth[a] = -2
                    a = self.to[path.pop() ^ 1]


def cut_labels(first: list[float], second: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it gets the first of two labels: the cheapest labelling where a node pays the other label's
    capacity and linked nodes with different labels pay the link."""
    flow = Flow(len(first))
    for k, (a, b) in enumerate(zip(first, second)):
        flow.edge(flow.s, k, a)
        flow.edge(k, flow.t, b)
    for a, b, w in links:
        flow.edge(a, b, w, w)
    return flow.source_side()


class Mark(NamedTuple):
    """A sign that may be markup: where it is, its line and enclosing element, and what it costs not to give it to the first or
    to the second of two labels."""

    at: int
    line: int
    element: int
    first: float
    second: float


#: Costs of a mark: a form that only one language has; one that prose has as well, for and against; a heading that Markdown has more often than wikis.
SURE, DOUBTFUL, PROSE, LEANING = 8.0, 1.0, 1.5, 0.02
#: Links between marks that follow each other, on one line and at any distance, and what is added inside the same element.
NEAR, FAR, SAME_ELEMENT = 0.8, 0.1, 0.5
#: A tag whose attributes are bare words only, as "a <b and c> d" has it; what stands before a backslash in a path.
BARE_ATTRIBUTES = re.compile(r"<[A-Za-z][\w-]*\s+[^=/<>\"']*[^\s=/<>\"'][^=/<>\"']*>\Z")
IN_PATH = re.compile(r"[\w:\\]\Z")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
TAG_NAME = re.compile(r"<(/?)([A-Za-z][\w-]*)[^<>]*?(/?)>")


def label_marks(marks: Sequence[Mark]) -> list[bool]:
    """For each mark, whether it gets the first label, by the minimum cut over all marks of a page: marks are linked to the next
    one the more strongly the fewer lines lie between, and to the next one of the same element."""
    if all(m.first > 0 == m.second for m in marks) or not any(m.first for m in marks):
        return [bool(m.first) for m in marks]  # nothing to cut
    links, last = [], {}
    for k, m in enumerate(marks):
        if k:
            links.append((k - 1, k, max(FAR, NEAR / (1 + m.line - marks[k - 1].line))))
        if m.element and m.element in last:
            links.append((last[m.element], k, SAME_ELEMENT))
        last[m.element] = k
    return cut_labels([m.first for m in marks], [m.second for m in marks], links)


class Page:
    """A body taken apart: code and formulas set aside, elements nested, and the marks of each language labelled by minimum cuts.

    Marks of HTML and of LaTeX are told from prose, marks of Markdown from those of wikis. `found` holds the languages that got a
    mark. What is set aside is delimited by marks that only one language has.
    """

    def __init__(self, body: str) -> None:
        self.found: set[str] = set()
        self.kept: list[tuple[str, str, str]] = []
        t = body.replace("\r\n", "\n").replace("\r", "\n")
        if "`" in t or "~~~" in t:
            t = FENCE.sub(lambda m: self._keep("markdown", "block", m[3], m[2].strip()), t)
        if "<" in t:
            t = WIKI_CODE.sub(lambda m: self._keep("wiki", "block" if "\n" in m[2] else "inline", m[2]), t)
        if "\\" in t:
            t = LATEX_CODE.sub(lambda m: self._keep("latex", "block" if m[1] else "inline", m[2] if m[1] else m[4]), t)
        if "<" in t:
            t = HTML_CODE.sub(self._html_code, t)
        if "`" in t:
            t = INLINE_CODE.sub(lambda m: self._keep("markdown", "inline", m[2].strip()), t)
        if "<!--" in t:
            t = COMMENT.sub(lambda m: self._keep("html", "gone", m[0]), t)
        if "$" in t or "\\" in t:
            t = MATH.sub(self._math, t)
        self.text = t
        self.starts = [0] + [m.end() for m in LINE_END.finditer(t)]
        self.elements = self._nest(t) if "<" in t else []
        self.places = [e[0] for e in self.elements]
        self.wiki_lines: set[int] = set()
        if "\\" in t:
            commands = [self._mark(m.start(), *((DOUBTFUL, PROSE) if not m[0].endswith("{") and IN_PATH.search(t, max(0, m.start() - 1), m.start()) else (SURE, 0.0))) for m in COMMAND.finditer(t)]
            if any(label_marks(commands)):
                self.found.add("latex")
        if "<" in t or "&" in t:
            tags = [self._mark(m.start(), *((DOUBTFUL, PROSE) if BARE_ATTRIBUTES.match(m[0]) else (SURE, 0.0))) for m in TAG.finditer(t)] if "<" in t else []
            tags += [self._mark(m.start(), SURE, 0.0) for m in ENTITY.finditer(t) if not m[1] or m[1] in html.entities.html5 or m[1] + ";" in html.entities.html5] if "&" in t else []
            if any(label_marks(sorted(tags))):
                self.found.add("html")
            if WIKI_TAG.search(t):
                self.found.add("wiki")
        # other languages' marks are blanked out, so that places stay what they are
        plain = COMMAND.sub(_blank, t) if "\\" in t else t
        plain = TAG.sub(_blank, plain) if "<" in t else plain
        if _spans(WIKI[:4], plain):
            plain = WIKI_INDENTED.sub(_blank, plain)
        wiki, markdown = _spans(WIKI, plain), _spans(MARKDOWN, plain)
        if wiki and markdown:  # such as a bracketed address with an underscore
            inside = sorted(wiki)
            reach = list(accumulate((b for _, b in inside), max))  # the farthest end of all marks up to each
            markdown = [m for m in markdown if not ((k := bisect_right(inside, (m[0], len(t)))) and reach[k - 1] >= m[1])]
        marks = [self._mark(a, SURE, 0.0) for a, _ in wiki] + [self._mark(a, 0.0, SURE) for a, _ in markdown]
        deep = {m.start() for m in DEEP.finditer(plain)}
        marks += [self._mark(a, 0.0, LEANING) for a in deep]
        if not marks:
            return
        marks = sorted(marks + [self._mark(m.start(), 0.0, 0.0) for m in SHARED.finditer(plain) if m.start() not in deep])
        labels = label_marks(marks)
        for m, is_wiki in zip(marks, labels):
            if m.first or m.second:
                self.found.add("wiki" if is_wiki else "markdown") if (m.first if is_wiki else m.second) else None
            if is_wiki:
                self.wiki_lines.add(m.line)

    def _mark(self, at: int, first: float, second: float) -> Mark:
        return Mark(at, bisect_right(self.starts, at) - 1, self.element_at(at), first, second)

    def element_at(self, at: int) -> int:
        """The number of the innermost element open at a place, 0 outside all."""
        k = bisect_right(self.places, at) - 1
        return self.elements[k][1] if k >= 0 else 0

    def _nest(self, t: str) -> list[tuple[int, int, tuple | None]]:
        """(place, number of the element, (its name, what is around it)) from each place on where an element opens or closes."""
        out, open_now, names, n = [], [], Counter(), 0
        for m in TAG_NAME.finditer(t):
            name = m[2].lower()
            if m[1]:
                while names[name]:
                    inner = open_now.pop()
                    names[inner[1][0]] -= 1
                    if inner[1][0] == name:
                        break
            elif not m[3] and name not in VOID:
                n += 1
                names[name] += 1
                open_now.append((n, (name, open_now[-1][1] if open_now else None)))
            else:
                continue
            out.append((m.end(), *(open_now[-1] if open_now else (0, None))))
        return out

    def _keep(self, language: str | None, how: str, content: str, info: str = "") -> str:
        if language:
            self.found.add(language)
        self.kept.append((how, content, info))
        return f"\ue000{len(self.kept) - 1}\ue001"

    def _html_code(self, m: re.Match) -> str:
        self.found.add("html")
        name = m[1].lower()
        if name in ("script", "style"):
            return self._keep("html", "gone", m[2])
        content = html.unescape(TAG.sub("", m[2])) if name in ("pre", "code", "samp", "kbd") else m[2]
        return self._keep("html", "block" if name == "pre" else "inline", content.removeprefix("\n"))

    def _math(self, m: re.Match) -> str:
        inline = m[4]
        if inline is not None and not FORMULA_SIGN.search(inline) and not FORMULA_NAME.fullmatch(inline):
            return m[0]
        content = next(g for g in m.groups() if g is not None)
        return self._keep("latex", "display" if m[1] is not None or m[2] is not None else "formula", content.strip())


LINE_END = re.compile("\n")
FORMULA_SIGN, FORMULA_NAME = re.compile(r"[\\^_=+<>/|]"), re.compile(r"[A-Za-z](?:'|\([A-Za-z]\))?")


def _blank(m: re.Match) -> str:
    return NOT_END.sub(" ", m[0])


NOT_END = re.compile(r"[^\n]")


def languages_of(body: str) -> list[str]:
    """The markup languages of a body, in the order of LANGUAGES."""
    found = Page(body).found
    return [x for x in LANGUAGES if x in found]


#: A line of table marks, rules or separators only.
BARE = re.compile(r"\s*(?:\{\||\|[-+}])?[-=_*~|·•«»‹›/]*\s*")
LETTER_RUN, CLOSED, STRUCTURE = re.compile(r"\p{L}+"), re.compile(r"[.!?](?:\s|$)"), re.compile(r"\s*(?:#{1,6} |=|\\(?:sub)*section)")
LINK = re.compile(r"\]\(|\[\[|<a[\s>]|\\href")
#: Lines that say something about the page and nothing to its reader: categories, info boxes, link definitions, preambles.
ABOUT_PAGE = re.compile(r"\s*(?:\[\[(?:Category|File|Image|Kategorie|Catégorie|Archivo|Fichier|Datei):[^\]]*\]\]|\{\{(?:Infobox|Navbox)[^{}]*\}\}|\[[^\[\]\n]+\]:\s+\S+|\\(?:documentclass|usepackage|begin|end|maketitle)\b[^\n]*|<!DOCTYPE[^>]*>)\s*$")
#: Elements whose blocks are taken for labelled examples of boilerplate and of content.
AROUND, INSIDE = {"nav", "footer", "header", "aside", "menu"}, {"p", "article", "main", "section", "td", "th", "blockquote"}
#: What tells content (positive) from boilerplate (negative), and its weights where a table gives too few examples to fit them.
FEATURES = ("always", "words", "closed", "set aside", "heading", "bare", "links", "about page")
WEIGHTS = (1.5, 0.4, 2.0, 3.0, 3.0, -3.0, -4.0, -9.0)
#: Bodies from which weights are fitted at most, examples of either kind needed, and rounds of fitting.
FIT_BODIES, LEAST_EXAMPLES, FIT_ROUNDS = 2000, 50, 300


def block_features(raw: str, clean: str) -> tuple[float, ...]:
    """The values of FEATURES of a block."""
    words = len(LETTER_RUN.findall(clean))
    links = len(LINK.findall(raw))
    bare = not words and bool(BARE.fullmatch(clean))  # figures and signs are content
    return (1.0, min(10.0, words), float(bool(CLOSED.search(clean))), float("\ue000" in raw), float(bool(STRUCTURE.match(raw))), float(bare), float(links >= 3 and words <= 2 * links), float(bool(ABOUT_PAGE.match(raw))))


def fit_weights(bodies: Sequence[str]) -> tuple[float, ...]:
    """Weights of FEATURES by logistic regression on labelled blocks of some bodies: blocks inside elements of AROUND are
    boilerplate, blocks of at least three words inside elements of INSIDE content. It starts from WEIGHTS and is held near them;
    with fewer than LEAST_EXAMPLES of a kind WEIGHTS stay."""
    x, y = [], []
    for body in dict.fromkeys(bodies):
        if "<" not in body:
            continue
        page = Page(body)
        for block in blocks_of(page):
            names = set(block.path)
            if block.raw.strip() and names & AROUND:
                x.append(block_features(block.raw, block.clean))
                y.append(0.0)
            elif names & INSIDE and len(LETTER_RUN.findall(block.clean)) >= 3:
                x.append(block_features(block.raw, block.clean))
                y.append(1.0)
    y = np.array(y)
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_EXAMPLES:
        return WEIGHTS
    x, w, start = np.array(x), np.array(WEIGHTS), np.array(WEIGHTS)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both kinds count alike
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - 0.1 * (((p - y) * share) @ x / len(y) + 0.01 * (w - start))
    return tuple(float(v) for v in w)


def block_costs(raw: str, clean: str, weights: Sequence[float] = WEIGHTS) -> tuple[float, float]:
    """What it costs to cut a block away and to keep it: the classifier's log odds."""
    if not raw.strip():
        return 0.0, 0.0
    z = sum(w * v for w, v in zip(weights, block_features(raw, clean)))
    return max(z, 0.0), max(-z, 0.0)


class Block(NamedTuple):
    raw: str
    clean: str
    path: tuple[str, ...]
    element: int


def blocks_of(page: Page) -> list[Block]:
    """The blocks of a page, which are its lines, with the elements they stand in."""
    text = page.text
    wiki_only = "wiki" in page.found and "markdown" not in page.found
    if "markdown" in page.found:
        text = UNDERLINED.sub(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip() + "\n", text)
    out, at = [], 0
    for k, (raw, start) in enumerate(zip(text.split("\n"), page.starts)):
        e = bisect_right(page.places, start + len(raw)) - 1
        around, path = page.elements[e][2] if e >= 0 else None, []
        while around:
            path.append(around[0])
            around = around[1]
        out.append(Block(raw, _tidy_line(raw, page.found, wiki_only or k in page.wiki_lines), tuple(reversed(path)), page.elements[e][1] if e >= 0 else 0))
    return out


def block_links(blocks: Sequence[Block]) -> list[tuple[int, int, float]]:
    """Neighbouring blocks are linked, more strongly the more enclosing elements they share, and so are blocks of one element that
    others stand between."""
    links, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            a = blocks[k - 1]
            shared = sum(1 for x, y in zip(a.path, b.path) if x == y)
            links.append((k - 1, k, 0.5 + 0.5 * (shared / max(len(a.path), len(b.path)) if shared else 0.0)))
        if b.element and b.element in last and last[b.element] < k - 1:
            links.append((last[b.element], k, 0.5))
        last[b.element] = k
    return links


UNDERLINED = re.compile(r"(?m)^([ ]{0,3}[^\s#>*+|=\-\n][^\n]*)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$")
HTML_STEPS = [
    (re.compile(r"<h([1-6])(?=[\s>])[^<>]*>", re.I), lambda m: "\n\n" + "#" * int(m[1]) + " "),
    (re.compile(r"</h[1-6]\s*>|</?(?:p|div|ul|ol|table|tr|section|article|blockquote|dl|dt|dd|header|footer|nav|main|center|form)(?=[\s/>])[^<>]*>", re.I), "\n"),
    (re.compile(r"<li(?=[\s>])[^<>]*>", re.I), "\n- "),
    (re.compile(r"<(?:br|hr)\s*/?>", re.I), "\n"),
    (re.compile(r"</t[hd]\s*>(?=\s*<t[hd])", re.I), " | "),
    (re.compile(r"<img(?=[\s/>])[^<>]*?alt=[\"']([^\"']*)[\"'][^<>]*>", re.I), r"\1"),
    (TAG, ""),
]
LATEX_STEPS = [
    (re.compile(r"\\(?:part|chapter|section)\*?\{([^{}]*)\}"), r"# \1"),
    (re.compile(r"\\((?:sub)+)section\*?\{([^{}]*)\}"), lambda m: "#" * (1 + len(m[1]) // 3) + " " + m[2]),
    (re.compile(r"^\s*\\item(?:\[[^\]]*\])?\s*"), "- "),
    (re.compile(r"~?\\(?:cite|ref|label|eqref|pageref|index|vspace|hspace|documentclass|usepackage|bibliography(?:style)?)\*?(?:\[[^\]]*\])?\{[^{}]*\}(?:\{[^{}]*\})?"), ""),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?"), ""),
    *[(re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}"), r"\1")] * 4,
    (re.compile(rf"\\(?:{_names(BARE_COMMANDS)})(?![A-Za-z])\s*"), ""),
    (re.compile(r"\\([%&#_${}])"), r"\1"),
    (re.compile(r"\\\\"), "\n"),
]
WIKI_ITEM = re.compile(r"^([*#]+)\s+")
WIKI_STEPS = [
    (re.compile(r"^(={1,6})\s*(.*?)\s*\1\s*$"), lambda m: "#" * len(m[1]) + " " + m[2]),
    (re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei|Fichier|Archivo):[^\[\]]*\]\]"), ""),
    (re.compile(r"\{\{[^{}|]*((?:\|[^{}|]*)*)\}\}"), lambda m: " ".join(x.strip() for x in m[1].split("|") if "=" not in x).strip()),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|ftp|mailto):[^\[\]\s]+(?:[ \t]([^\[\]\n]*))?\](?!\()"), r"\1"),
    (re.compile(r"(?<!')'{2,5}(?!')"), ""),
    (WIKI_TAG, ""),
]
MARKDOWN_STEPS = [
    (re.compile(r"^[ ]{0,3}\[[^\[\]]+\]:\s+\S+.*$|^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$|^[ ]{0,3}\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$"), ""),
    (re.compile(r"^[ ]{0,3}>[ \t]?"), ""),
    (re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\([^()\s]*\))?[^()\s]*(?:\s+\"[^\"]*\")?\)|!?\[([^\[\]]+)\]\[[^\[\]]*\]"), lambda m: m[1] if m[1] is not None else m[2]),
    (re.compile(r"(?<![\w*\\])(\*\*|\*)(?=[^\s*])(.+?)(?<=[^\s*])\1(?![\w*])|(?<![\w\\])(__|_)(?=[^\s_])(.+?)(?<=[^\s_])\3(?!\w)|(~~)(?=\S)(.+?)(?<=\S)~~"), lambda m: m[2] or m[4] or m[6]),
    (re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>"), r"\1"),
    (re.compile(r"^([ ]*)[*+-][ \t]+"), r"\1- "),
    (re.compile(r"^[ ]{0,3}\|(.*)\|[ \t]*$"), lambda m: m[1].strip()),
]
#: Signs without which a line has no mark of a language.
SIGNS = {"html": re.compile("[<&]"), "latex": re.compile(r"\\"), "wiki": re.compile(r"[=\[{'<*#]"), "markdown": re.compile(r"[\[\]*_~<>|+-]")}
STEPS = {"html": HTML_STEPS, "latex": LATEX_STEPS, "wiki": WIKI_STEPS, "markdown": MARKDOWN_STEPS}


def _tidy_line(line: str, found: set[str], wiki_line: bool) -> str:
    for language in ("html", "latex", "wiki", "markdown"):
        if language not in found or not SIGNS[language].search(line):
            continue
        if language == "wiki" and wiki_line:
            line = WIKI_ITEM.sub(lambda m: "  " * (len(m[1]) - 1) + ("1. " if m[1][-1] == "#" else "- "), line)
        for pattern, new in STEPS[language]:
            line = pattern.sub(new, line)
        if language == "html":
            line = html.unescape(line)
    return line


TRAILING, BLANK_LINES = re.compile(r"[ \t]+(?=\n|\Z)"), re.compile(r"\n{3,}")


def clean_text(body: str, weights: Sequence[float] = WEIGHTS) -> tuple[str, list[str]]:
    """(clean text, markup languages) of a body; a body without markup comes back unchanged.

    Headings read "# ", "## " and so on, list items "- " or "1. ", code blocks stand between lines of ```, formulas
    between $ or $$; other marks go. Blocks are labelled content or boilerplate by a minimum cut: a classifier's costs are the
    capacities to the terminals, adjacency and common elements are the links. Code comes back as it was.
    """
    free = None
    if "\ue000" in body:  # stands for what is set aside, so the body's own gets another sign
        free = next(c for c in map(chr, range(0xE002, 0xF8FF)) if c not in body)
        body = body.replace("\ue000", free)
    page = Page(body)
    found = [x for x in LANGUAGES if x in page.found]
    if not found:
        return (body.replace(free, "\ue000") if free else body), []
    blocks = blocks_of(page)
    costs = [block_costs(b.raw, b.clean, weights) for b in blocks]
    content = cut_labels([a for a, _ in costs], [b for _, b in costs], block_links(blocks)) if any(b for _, b in costs) else [True] * len(blocks)
    out = "\n".join(b.clean for b, c in zip(blocks, content) if c or not b.raw.strip())
    out = BLANK_LINES.sub("\n\n", TRAILING.sub("", out)).strip("\n")

    def back(m: re.Match) -> str:
        how, x, info = page.kept[int(m[1])]
        if how == "inline":
            return PLACE.sub(back, x)
        x = PLACE.sub(source, x)
        if how == "block":
            text = f"```{info}\n{x}" + ("" if x.endswith("\n") or not x else "\n") + "```"
        else:
            text = {"display": f"$$ {x} $$", "formula": f"${x}$", "gone": ""}[how]
        return f"\ue000{text}\ue001" if how in ("block", "display") else text

    def source(m: re.Match) -> str:
        return PLACE.sub(source, page.kept[int(m[1])][1])

    out = PLACE.sub(back, out)
    if "\ue000" in out:  # blocks stand on lines of their own, with a blank line around
        parts = OWN_LINES.split(out)
        out = "".join(p if k % 2 else p.strip("\n") for k, p in enumerate(parts)) if len(parts) == 1 else "\n\n".join(x for k, p in enumerate(parts) if (x := p if k % 2 else BLANK_LINES.sub("\n\n", p).strip("\n")).strip())
    return (out.replace(free, "\ue000") if free else out), found


OWN_LINES = re.compile("\ue000(.*?)\ue001", re.S)


def clean_bodies(df: DataFrame, id_column: str = "doc_id", body: str = "body") -> DataFrame:
    """(id, markup, text): the languages of each body, an empty array for a plain one, and its clean text.

    Null bodies give null text and no language, empty and blank ones come back unchanged. Repeated rows are each reported.
    Whole bodies are parsed, however long. Other columns are ignored. A narrow operator: no shuffle beyond spreading. The weights
    of the block classifier are fitted beforehand on FIT_BODIES bodies at most (chosen by hash); the languages don't rest on them.
    """

    rows = df.select(F.col(id_column).alias("id"), F.col(body).alias("body"))
    known = rows.filter(F.contains("body", F.lit("<")))
    share = F.pmod(F.xxhash64("body"), F.lit(1_000_000)) < F.lit(1_000_000 * FIT_BODIES // max(1, df.count()))
    weights = fit_weights([r["body"] for r in known.filter(share).select("body").limit(FIT_BODIES).collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *((None, []) if b is None else clean_text(b, weights))) for i, b in zip(pdf["id"], pdf["body"])]
            yield pd.DataFrame(out, columns=["id", "text", "markup"])[["id", "markup", "text"]]

    kind = df.schema[id_column].dataType.simpleString()
    return spread(rows).mapInPandas(run, f"id {kind}, markup array<string>, text string").withColumnRenamed("id", id_column)
