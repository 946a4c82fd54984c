"""Python side of page extraction: select elements of one page by the site's selectors.

It only reports what matched, in page order; every choice, filter and clean-up is left to Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)
SILENT = frozenset(["script", "style", "template"])

Test = tuple[str, str, str]


Steps = tuple[tuple[str, str, tuple[Test, ...]], ...]
COMPILED: dict[str, Steps] = {}


def compile_selector(selector: str) -> Steps:
    """Steps ``(combinator, tag, attribute tests)`` of a selector, left to right; each selector is read once."""
    if selector not in COMPILED:
        COMPILED[selector] = _steps(selector)
    return COMPILED[selector]


def _steps(selector: str) -> Steps:
    steps, combinator = [], " "
    for token in re.findall(r"""(?:[^\s>\["]|\[[^\]]*\])+|>""", selector):
        if token == ">":
            combinator = ">"
            continue
        tag = re.match(r"[\w-]*", token).group()
        tests: list[Test] = [("class", "~", name) for name in re.findall(r"\.([\w-]+)", re.sub(r"\[.*?\]", "", token))]
        tests += [("id", "=", name) for name in re.findall(r"#([\w-]+)", re.sub(r"\[.*?\]", "", token))]
        for name, op, value in re.findall(r"""\[([\w-]+)(?:([*^]?=)"?([^"\]]*)"?)?\]""", token):
            tests.append((name, op or "?", value))
        steps.append((combinator, tag, tuple(tests)))
        combinator = " "
    return tuple(steps)


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    hidden: bool = False
    scope: int = -1
    scope_rank: int = 1_000
    figure: int = -1
    captures: list = field(default_factory=list)

    def passes(self, tag: str, tests: tuple[Test, ...]) -> bool:
        if tag and tag != self.tag:
            return False
        for name, op, value in tests:
            have = self.attrs.get(name)
            if have is None:
                return False
            ok = {
                "?": True,
                "~": value in have.split(),
                "=": have == value,
                "^=": have.startswith(value),
                "*=": value in have,
            }[op]
            if not ok:
                return False
        return True


def matches(path: list[Element], selector: str) -> bool:
    """Whether the last element of ``path`` is selected; ancestors are taken innermost first."""
    steps = compile_selector(selector)
    combinator, tag, tests = steps[-1]
    if not path[-1].passes(tag, tests):
        return False
    at = len(path) - 2
    for outer_combinator, tag, tests in reversed(steps[:-1]):
        if combinator == ">":
            if at < 0 or not path[at].passes(tag, tests):
                return False
        else:
            while at >= 0 and not path[at].passes(tag, tests):
                at -= 1
            if at < 0:
                return False
        at -= 1
        combinator = outer_combinator
    return True


@dataclass(frozen=True)
class Place:
    """Where a field is found: a selector, and an attribute of the element or else its text.

    ``join`` puts the stripped text nodes together; ``None`` keeps the text as it is.
    """

    name: str
    selector: str
    attribute: str | None = None
    join: str | None = ""
    in_scope: bool = True
    body: bool = False  # leaves excluded elements out


class SiteReader:
    """Selectors of one site, ordered for quick tests by tag name."""

    def __init__(self, scopes: list[str], places: list[Place], exclude: list[str], join: str | None = ""):
        self.join = join
        self.scopes = self._by_tag(list(enumerate(scopes)), lambda x: x[1])
        self.exclude = self._by_tag(exclude, lambda x: x)
        self.places = self._by_tag(list(enumerate(places)), lambda x: x[1].selector)

    @staticmethod
    def _by_tag(items, selector):
        """``tag -> items`` whose last step may match that tag, in the given order; None for all other tags."""
        tags = {compile_selector(selector(i))[-1][1] for i in items}
        return {t: [i for i in items if compile_selector(selector(i))[-1][1] in (t, "")] for t in tags | {""}}

    @staticmethod
    def of(table: dict, tag: str) -> list:
        return table.get(tag) or table[""]


class PageReader(HTMLParser):
    """One pass over a page. Scopes are numbered in page order; a scope opens inside another only if more trusted."""

    def __init__(self, site: SiteReader):
        super().__init__(convert_charrefs=True)
        self.site = site
        self.path: list[Element] = []
        self.found: list[dict] = []
        self.n_scopes = 0
        self.n_figures = 0
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        self._end_text()
        if tag in CLOSES_P and any(e.tag == "p" for e in self.path):
            self._close("p")
        element = Element(tag, {k: v or "" for k, v in attrs})
        if self.path:
            outer = self.path[-1]
            element.scope, element.scope_rank, element.hidden = outer.scope, outer.scope_rank, outer.hidden
            element.figure = outer.figure
        self.path.append(element)
        site = self.site
        for rank, selector in site.of(site.scopes, tag):
            if rank < element.scope_rank and matches(self.path, selector):
                element.scope, element.scope_rank, element.hidden = self.n_scopes, rank, False
                self.n_scopes += 1
                self._capture(element, rank, Place("scope", selector, join=site.join, body=True))
                break
        if element.scope >= 0 and not element.hidden:
            element.hidden = any(matches(self.path, s) for s in site.of(site.exclude, tag))
        for rank, place in site.of(site.places, tag):
            wanted = (element.scope >= 0 or not place.in_scope) and not (place.body and element.hidden)
            if wanted and matches(self.path, place.selector):
                if place.name == "figure":  # what lies within belongs to this figure
                    element.figure, self.n_figures = self.n_figures, self.n_figures + 1
                self._capture(element, rank, place)
        if tag in VOID:
            self.path.pop()

    def _capture(self, element: Element, rank: int, place: Place) -> None:
        capture = {
            "scope": element.scope, "name": place.name, "rank": rank, "place": place, "nodes": [],
            "attrs": element.attrs, "figure": element.figure, "tag": element.tag,
        }
        if place.attribute is None:
            element.captures.append(capture)
        self.found.append(capture)

    def handle_endtag(self, tag):
        self._end_text()
        if any(e.tag == tag for e in self.path):
            self._close(tag)

    def _close(self, tag):
        while self.path and self.path.pop().tag != tag:
            pass

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self._end_text()

    def _end_text(self):
        if not self.text:
            return
        data, self.text = "".join(self.text), []
        if not self.path:
            return
        inner = self.path[-1]
        silent = inner.tag in SILENT
        for element in self.path:
            for capture in element.captures:
                if capture["place"].body and (inner.hidden or silent):
                    continue
                if not silent or element is inner:
                    capture["nodes"].append(data)


def _text(nodes: list[str], join: str | None) -> str:
    return "".join(nodes) if join is None else join.join(t for n in nodes if (t := n.strip()))


def read_page(html: str | None, site: SiteReader) -> Iterator[dict]:
    """What one page holds at the places of its site."""
    if not html:
        return
    reader = PageReader(site)
    reader.feed(html)
    reader.close()
    reader._end_text()
    for found in reader.found:
        place = found["place"]
        text = found["attrs"].get(place.attribute) if place.attribute else _text(found["nodes"], place.join)
        yield {
            "scope": found["scope"], "name": found["name"], "rank": found["rank"], "text": text,
            "attrs": list(found["attrs"].items()), "figure": found["figure"], "tag": found["tag"],
        }
