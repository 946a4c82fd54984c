"""Main text of web pages: what is left without the site's template.

Subtrees of block elements are hashed by their tags and texts, attributes aside, and counted per host over
different pages: copies of one page count once. A subtree that stands on at least SHARE of a host's different
pages, and on MIN_PAGES of them, belongs to the template and is deleted, and so is everything that names itself
something other than the article (elements, roles, classes and ids below). If a page has an article or main
element, its text is what is inside; otherwise all that is left.

Blocks are runs of text between block elements; ``br`` is white space. Character references are decoded. Unclosed
elements end where their parents or the page do, an open p where the next block begins; unclosed comments and
scripts end with the page.

Null or empty html: empty text. Null url, or one without a host: no template is known, the names still count. Null
ids are kept, and repeated rows come back as often as they came in; as copies of one page they count once. Columns
other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import small_batches, stored

SHARE = 0.5
MIN_PAGES = 5
# Rows (host, subtree) that are broadcast; a host has fewer than (elements of a page / SHARE). More are shuffled.
BROADCAST_ROWS = 100_000

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select canvas video audio".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var".split()
)
OTHER = frozenset("head nav footer aside form dialog menu button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar cookie cookies consent notice notices newsletter subscribe subscription share "
    "sharing social related recommended comment comments disqus footer popup modal overlay login signup toolbar "
    "pagination pager widget".split()
)
NAMES_OUTSIDE = frozenset(["header", "masthead"])  # an article may have a header of its own
MAIN = frozenset(["article", "main"])
NO_TEMPLATE = frozenset(["html", "body", "article", "main"])

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^<>]*\Z",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
_PARTS = re.compile(r"[^a-z]+")


def _is_other(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element names itself something other than the article."""
    if tag in OTHER or (tag == "header" and not inside):
        return True
    if tag in NO_TEMPLATE or not attributes:
        return False
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role":
            if value in ROLES:
                return True
        elif name in ("class", "id"):
            parts = set(_PARTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values)).lower()))
            if parts & NAMES or (not inside and parts & NAMES_OUTSIDE):
                return True
    return False


class Page:
    """One pass over a page: the blocks left, and the hashes of block subtrees."""

    def __init__(self, text: str, deleted: frozenset[int] = frozenset()):
        self.blocks: list[tuple[str, str, bool]] = []
        self.hashes: list[int] = []
        self.has_main = False
        self._deleted, self._words, self._inside = deleted, [], 0
        # open elements: tag, number of blocks before it
        self._open: list[tuple[str, int]] = []
        self._read(text)
        self._end_block()
        while self._open:
            self._close_last()

    def _end_block(self) -> None:
        if self._words:
            text = " ".join(html.unescape("".join(self._words)).split())
            self._words = []
            if text:
                tag = next((t for t, _ in reversed(self._open) if t not in INLINE), "")
                self.blocks.append((tag, text, self._inside > 0))

    def _close_last(self) -> None:
        tag, first = self._open[-1]
        if tag in INLINE:
            self._open.pop()
            return
        self._end_block()
        self._open.pop()
        if tag in MAIN:
            self._inside -= 1
        if tag not in NO_TEMPLATE and len(self.blocks) > first:
            said = hashlib.blake2b(tag.encode("utf-8", "surrogatepass"), digest_size=8)
            for inner, text, _ in self.blocks[first:]:
                said.update(f"\x00{inner}\x01{text}".encode("utf-8", "surrogatepass"))
            key = int.from_bytes(said.digest(), "little", signed=True)
            self.hashes.append(key)
            if key in self._deleted:
                del self.blocks[first:]

    def _close(self, tag: str) -> None:
        """Ends the innermost open element of that name and all within it; nothing if there is none."""
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] == tag:
                while len(self._open) > depth:
                    self._close_last()
                return
            if tag in INLINE and self._open[depth][0] not in INLINE:
                return

    def _begin(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
            open_tags = [t for t, _ in self._open]
            if "p" in open_tags:
                self._close("p")
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and tag in open_tags:
                last = max(i for i, t in enumerate(open_tags) if t == tag)
                if not {"ul", "ol", "dl", "table"} & set(open_tags[last:]):
                    self._close(tag)
        if tag in MAIN:
            self.has_main = True
            self._inside += 1
        self._open.append((tag, len(self.blocks)))

    def _read(self, text: str) -> None:
        at, skip, depth = 0, None, 0  # skip: the element that is being left out, with its nesting
        end = len(text)
        while at < end:
            found = _MARKUP.search(text, at)
            if found is None:
                if skip is None:
                    self._words.append(text[at:])
                return
            if skip is None and found.start() > at:
                self._words.append(text[at : found.start()])
            at = found.end()
            slash, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            tag = name.lower()
            if skip is not None:
                if tag == skip:
                    depth += -1 if slash else 1
                    if depth == 0:
                        skip = None
                elif tag in RAW and not slash:
                    at = self._after_raw(text, tag, at, attributes)
                elif skip == "head" and tag == "body":
                    skip = None
                    self._begin(tag)
                continue
            if slash:
                if tag == "p" and not any(t == "p" for t, _ in self._open):
                    self._end_block()
                elif tag == "br":
                    self._words.append(" ")
                else:
                    self._close(tag)
            elif tag in RAW:
                self._words.append(" ")
                at = self._after_raw(text, tag, at, attributes)
            elif tag in VOID:
                if tag == "hr":
                    self._end_block()
                self._words.append(" ")
            elif _is_other(tag, attributes, self._inside > 0):
                if tag not in INLINE:
                    self._end_block()
                skip, depth = tag, 1
            else:
                self._begin(tag)

    @staticmethod
    def _after_raw(text: str, tag: str, at: int, attributes: str) -> int:
        if attributes.endswith("/") and tag in ("svg", "math"):
            return at
        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
        return close.end() if close else len(text)

    def text(self) -> str:
        return "\n\n".join(t for _, t, inside in self.blocks if inside or not self.has_main)


def _subtrees(batches):
    for batch in batches:
        host, page, tree = [], [], []
        for h, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            parsed = Page(source.as_py() or "")
            whole = hashlib.blake2b(digest_size=8)
            for tag, text, _ in parsed.blocks:
                whole.update(f"\x00{tag}\x01{text}".encode("utf-8", "surrogatepass"))
            found = set(parsed.hashes)
            host += [h] * len(found)
            page += [int.from_bytes(whole.digest(), "little", signed=True)] * len(found)
            tree += found
        yield pa.record_batch(
            [pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(tree, pa.int64())],
            names=["host", "page", "tree"],
        )


def _texts(batches):
    known: dict = {}
    for batch in batches:
        texts = []
        for h, deleted, source in zip(
            batch.column("host").to_pylist(), batch.column("deleted"), batch.column("html"), strict=True
        ):
            if h not in known:
                known[h] = frozenset(deleted.as_py() or ())
            texts.append(Page(source.as_py() or "", known[h]).text())
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def host_of(url: str = "url"):
    """Lower-case host of an absolute address, without user and port; null if there is none."""
    authority = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    return F.when(host != "", host)


def template_subtrees(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, tree)``: hashes of the subtrees that recur across a host's different pages."""
    rows = small_batches(pages.select(host_of().alias("host"), "html").where("host IS NOT NULL")).mapInArrow(
        _subtrees, "host string, page long, tree long"
    )
    once = stored(rows.distinct(), "subtrees")
    counted = once.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    sizes = once.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return (
        counted.where(F.col("n") >= min_pages)
        .join(sizes, "host")
        .where(F.col("n") >= F.lit(share) * F.col("pages"))
        .select("host", "tree")
    )


def page_texts(
    pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``."""
    template = stored(template_subtrees(pages, share, min_pages), "template")
    lists = template.groupBy("host").agg(F.collect_list("tree").alias("deleted"))
    if template.count() <= limit:
        lists = F.broadcast(lists)
    source = small_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of().alias("host"), "html"))
    return source.join(lists, "host", "left").mapInArrow(
        _texts, "page_id long, url string, text string, n_chars long"
    )
