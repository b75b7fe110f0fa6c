"""Operator 7, HTML extraction with removal of site templates.

Two passes over the pages. The first reads each page into blocks, leaves out
what its markup names as menu, header, footer, sidebar, notice, advert, form,
script, style or reader comment (unless nothing would be left by such names),
and lists hashes of the element subtrees that remain. Spark counts them per section, over different main texts; sections are
the host and each folder of its paths. A subtree that recurs in most of a
section's texts is part of its template, and the second pass deletes it from the
section's pages as well.

Defined results: null, empty and text-free pages, and pages of which all blocks
belong to templates, give an empty text. A missing
URL is a host of its own name, ''. Unclosed and stray tags never fail; text
outside all tags counts as a block. Pages of any length and depth are read whole,
in linear time. Repeated pages are extracted one by one and
count as one text of their host. Input columns other than id, URL and html are
not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import materialize, slices

#: A template recurs in at least so many different texts of a section and in this share of them.
LEAST_TEXTS = 5
LEAST_SHARE = 0.6
#: Templates up to this many rows (16 bytes and a section's name each) go to the executors as one broadcast; beyond it they are joined.
BROADCAST_ROWS = 50_000

# Element kinds of HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video xmp noembed noframes".split())
OMIT = frozenset("head nav footer aside form menu dialog button select search".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "legend", "summary", "figcaption", "tbody", "tfoot", "thead", "tr"}
WRAPPERS = frozenset({"form"})
SPACING = frozenset("br td th wbr img".split())
OMIT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
OMIT_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notices?|alert\w*|newsletter\w*|subscri\w*|signup|login|popup\w*|modal\w*|overlay\w*|"
    r"side[-_]?bar\w*|widgets?|menus?|nav|navbar|navigation|navi|topbar|breadcrumbs?|foot|footer|comments?|commentlist|disqus\w*|replies|respond|share|sharing|social\w*|related|recommend\w*|"
    r"pagination|pager|paywall|toolbar|masthead|skip\w*|search\w*|forms?)(?:$|[^a-z])"
)
OMIT_HEAD_NAMES = re.compile(r"(?:^|[^a-z])(?:head|header|site-?head\w*|page-?head\w*)(?:$|[^a-z])")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
#: Words before and after a name that tell of a page's layout, not of the element: ``has-sidebar``, ``comments-open``.
_LAYOUT = re.compile(r"(?:^|[-_])(?:has|with|without|no|hide|show)[-_][a-z0-9_-]*|[a-z0-9_-]*[-_](?:open|closed|enabled|disabled|on|off|left|right|layout)(?=$|\s)")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Start tags that close an open element of their kind, unless a list or table of their own lies between.
CLOSED_BY = {"li": ((("li",), ("ul", "ol", "menu")),), "dt": ((("dt", "dd"), ("dl",)),), "dd": ((("dt", "dd"), ("dl",)),), "tr": ((("tr",), ("table",)),), "option": ((("option",), ("select",)),)}
_FOLDER = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*((?:/[^/?#]+)*)/"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _left_out(tag: str, attrs: str, in_article: bool, names: bool) -> bool:
    """Whether an element is no part of the article, by its kind or, with ``names``, by its names and roles."""
    if tag in OMIT and (names or tag not in WRAPPERS) or tag == "header" and not in_article:
        return True
    if not attrs or not names or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            if value.strip() in OMIT_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name in ("class", "id"):
            value = " ".join(_LAYOUT.sub(" ", v) for v in value.split()) if "-" in value or "_" in value else value
            if OMIT_NAMES.search(value) or not in_article and OMIT_HEAD_NAMES.search(value):
                return True
    return False


class _Open:
    """The open elements, each with what holds inside it; where those of each tag stand is known at once."""

    def __init__(self):
        self.rows: list[tuple[str, int, bool, bool, int]] = []  # tag, element or -1, left out, in the article, innermost element
        self.at: dict[str, list[int]] = {}

    def inner(self) -> int:
        return self.rows[-1][4] if self.rows else -1

    def push(self, tag: str, element: int, out: bool, article: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.rows))
        self.rows.append((tag, element, out, article, element if element >= 0 else self.inner()))

    def cut(self, k: int) -> None:
        while len(self.rows) > k:
            self.at[self.rows.pop()[0]].pop()

    def last(self, tags: tuple[str, ...], upto: tuple[str, ...] = ()) -> int:
        """The innermost of ``tags`` that is not outside one of ``upto``, or -1."""
        k = max([self.at[t][-1] for t in tags if self.at.get(t)], default=-1)
        return k if k < 0 or all(not self.at.get(u) or self.at[u][-1] < k for u in upto) else -1


class Page:
    """Blocks of a page in order; each with the innermost block element around it. One pass, linear in the source.

    An element's hash covers the names of the elements in it and its text, not
    attributes, so links of their own do not tell two copies of a template apart.
    """

    def __init__(self, source: str, names: bool = True):
        self.source = source
        self.blocks: list[tuple[str, int, bool]] = []  # text, element or -1, inside the article
        self.parents: list[int] = []
        self.hashes: list[int] = []
        self._read(names)
        if names and not self.blocks and source:
            # Names that would leave nothing, and a form around everything, say nothing.
            self.parents, self.hashes = [], []
            self._read(False)

    def _tokens(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(start, end, is an end tag, tag, attributes) of tags, comments and declarations (no tag) in order.

        Quotes hide ``>`` in a tag. If a tag's quotes do not close, it ends at its
        first ``>``, and so do all after it. ``send`` moves on to a place.
        """
        source, at, quotes = self.source, 0, True
        while (start := source.find("<", at)) >= 0:
            after = source[start + 1 : start + 2]
            if source.startswith("<!--", start):
                end = min((e + n for e, n in ((source.find("-->", start + 4), 3), (source.find("--!>", start + 4), 4)) if e >= 0), default=len(source))
                moved = yield start, end, False, "", ""
            elif m := _NAME.match(source, start + 1 + (after == "/")):
                end, i = -1, m.end()
                while quotes and (stop := _STOP.search(source, i)):
                    if stop[0] == ">":
                        end = stop.end()
                        break
                    i = source.find(stop[0], stop.end()) + 1
                    if not i:
                        break
                if end < 0:
                    quotes = False
                    end = source.find(">", m.end()) + 1
                    if not end:
                        return
                moved = yield start, end, after == "/", m[0].lower(), source[m.end() : end - 1]
            elif after and after in "!?/":
                end = source.find(">", start) + 1
                if not end:
                    return
                moved = yield start, end, False, "", ""
            else:
                moved, end = None, start + 1
            at = end if moved is None else moved

    def _read(self, names: bool) -> None:
        source, stack, text, at = self.source, _Open(), [], 0
        sums = [xxhash.xxh3_64()]  # of the page, then of each element
        out = in_article = False

        def flush() -> None:
            if text:
                block = " ".join(html_lib.unescape("".join(text)).split())
                if block:
                    inner = stack.inner()
                    self.blocks.append((block, inner, in_article))
                    sums[inner + 1].update(block.encode("utf-8", "surrogatepass") + b"\0")
                text.clear()

        def close_to(k: int) -> None:
            nonlocal out, in_article
            for row in reversed(stack.rows[k:]):
                element = row[1]
                if element >= 0:
                    self.hashes[element] = sums[element + 1].intdigest() - (1 << 63)
                    sums[self.parents[element] + 1].update(sums[element + 1].digest())
            stack.cut(k)
            out, in_article = stack.rows[-1][2:4] if stack.rows else (False, False)

        tokens = self._tokens()
        token = next(tokens, None)
        while token:
            start, end, ends, tag, attrs = token
            if start > at and not out:
                text.append(source[at:start])
            at, moved = end, None
            if ends:
                where = stack.at.get(tag)
                if where:
                    k = where[-1]
                    if tag in BLOCK or stack.rows[k][2] or any(row[1] >= 0 for row in stack.rows[k:]):
                        flush()
                    close_to(k)
                elif tag == "p":
                    flush()
            elif tag:
                if tag in CLOSES_P and stack.at.get("p") and (k := stack.last(("p",), ("article", "div", "section", "td", "li", "main"))) >= 0:
                    flush()
                    close_to(k)
                for own, upto in CLOSED_BY.get(tag, ()):
                    if (k := stack.last(own, upto)) >= 0:
                        flush()
                        close_to(k)
                if tag in RAW:
                    if not (attrs.rstrip().endswith("/") and tag in ("svg", "math")):
                        close = _RAW_ENDS[tag].search(source, at)
                        at = moved = close.end() if close else len(source)
                else:
                    if tag in BLOCK:
                        flush()
                    elif tag in SPACING:
                        text.append(" ")
                    if tag not in VOID:
                        drop = out or _left_out(tag, attrs, in_article, names)
                        article = in_article or not drop and (tag in ("article", "main") or 'role="main"' in attrs)
                        element = -1
                        if tag in BLOCK and not out:
                            element = len(self.parents)
                            self.parents.append(stack.inner())
                            self.hashes.append(0)
                            sums.append(xxhash.xxh3_64(tag.encode()))
                        if drop != out:
                            flush()
                        stack.push(tag, element, drop, article)
                        out, in_article = drop, article
            try:
                token = tokens.send(moved)
            except StopIteration:
                break
        if at < len(source) and not out:
            text.append(source[at:])
        flush()
        close_to(0)

    def article(self) -> list[tuple[str, int, bool]]:
        """The blocks of the article, or all blocks of a page without one."""
        return [b for b in self.blocks if b[2]] or self.blocks

    def main(self, templates: frozenset[int] | set[int] = frozenset()) -> list[str]:
        """Texts of the article's blocks that are in no template."""
        if not templates:
            return [b[0] for b in self.article()]
        gone: list[bool] = []
        for h, parent in zip(self.hashes, self.parents, strict=True):  # parents come first
            gone.append(h in templates or parent >= 0 and gone[parent])
        return [text for text, element, _ in self.article() if element < 0 or not gone[element]]

    def subtrees(self) -> set[int]:
        """Hashes of the elements that hold blocks of the article."""
        seen: set[int] = set()
        for _, element, _ in self.article():
            while element >= 0 and element not in seen:
                seen.add(element)
                element = self.parents[element]
        return {self.hashes[e] for e in seen}


def sections(folder: str) -> list[str]:
    """The host and each folder down to this one."""
    parts = folder.split("/")
    return ["/".join(parts[: i + 1]) for i in range(len(parts))]


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.col(url_col).cast("string")
    folder = F.coalesce(F.concat(F.lower(F.regexp_extract(url, _HOST, 1)), F.regexp_extract(url, _FOLDER, 1)), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), folder.alias("folder"), F.col(html_col).cast("string").alias("html"))


def templates(pages: DataFrame, least_texts: int = LEAST_TEXTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``section, subtree``: subtrees that recur across most different texts of the section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4_000_000, "html"):
                names, texts, trees = [], [], []
                for folder, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    page = Page(source or "")
                    if not page.blocks:
                        continue
                    own = [0, *page.subtrees()]  # 0 counts the section's texts
                    text = xxhash.xxh3_64_intdigest("\n".join(page.main())) - (1 << 63)
                    for section in sections(folder):
                        names += [section] * len(own)
                        texts += [text] * len(own)
                        trees += own
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.int64()), pa.array(trees, pa.int64())], names=["section", "text", "subtree"])

    seen = pages.select("folder", "html").mapInArrow(run, "section string, text long, subtree long").distinct()
    counts = seen.groupBy("section", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_texts)
    counts = materialize(counts, "subtrees")
    total = counts.where("subtree = 0").select("section", F.col("n").alias("texts"))
    return counts.where("subtree <> 0").join(total, "section").where(F.col("n") >= F.col("texts") * least_share).select("section", "subtree")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    src = _pages(pages, id_col, url_col, html_col)
    found = materialize(templates(src), "templates")
    few = found.limit(broadcast_rows + 1).collect()
    shared = None
    if len(few) <= broadcast_rows:
        by_section: dict[str, set[int]] = {}
        for r in few:
            by_section.setdefault(r["section"], set()).add(r["subtree"])
        shared = pages.sparkSession.sparkContext.broadcast(by_section)
        joined = src.select("page_id", "url", "html", "folder")
    else:
        parts = F.split("folder", "/")
        names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        by_folder = src.select("folder").distinct().withColumn("section", F.explode(names)).join(found, "section").groupBy("folder").agg(F.collect_set("subtree").alias("trees"))
        joined = src.join(by_folder.hint("merge"), "folder", "left").select("page_id", "url", "html", "trees")

    def own_trees(value: str | list[int] | None) -> set[int]:
        if shared is None:
            return set(value or ())
        return set().union(*(shared.value.get(x, ()) for x in sections(value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4_000_000, "html"):
                texts = ["\n".join(Page(h or "").main(own_trees(t))) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
