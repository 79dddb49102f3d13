"""Main text of web pages by consensus of the pages of a host.

Each page's containers are scored by the text that stands in them, in Spark
tasks. A container is named by its path of tags and classes, with numbers in them
generalised. The best container is raised to the outermost one above that is named
as content, so that a headline or section beside it is not lost. The scores are
votes for paths, summed per host by Spark; pages are then extracted again from the
first winning path that they have, raised in the same way. A page without one falls
back on its own best container.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import checkpointed, no_name_clash, shared_dir

# Kinds of elements, and words in classes and ids that mark what is no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption summary address".split())
CONTAINERS = frozenset("html body main article section div ul ol dl table tbody thead tfoot tr figure details center "
                       "nav header footer aside form fieldset dialog menu head title hr".split())
BLOCKS = TEXT_BLOCKS | CONTAINERS
LEFT_OUT = frozenset("head title nav header footer aside form menu dialog button select option label input fieldset "
                     "script style noscript template svg math iframe object canvas audio video textarea".split())
NEVER_BY_CLASS = frozenset(["html", "body", "article", "main"])
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "header footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments disqus "
    "respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "breadcrumb breadcrumbs pagination pager toolbar widget widgets form search skip hidden".split())
#: Of these, the ones that sections of an article have as well.
SOFT_WORDS = frozenset("header related search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
GOOD_WORDS = frozenset("article content main post entry story text body".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

#: A path is kept for a host if it is the best one of so many percent of its pages.
LEAST_SHARE, MOST_PATHS = 5, 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])[^>]*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+>", re.S | re.I)
#: A tag whose quoted values may hold ">", looked for in so many characters; else one that ends at the next ">".
_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>[^>]*+)>")
LONGEST_TAG = 4096
#: Longer paths are named by a digest of their beginning.
LONGEST_PATH = 400
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element(NamedTuple):
    parent: int
    tag: str
    name: str  # tag and classes, generalised
    left_out: int  # ALWAYS, BY_WORD, BY_LINKS or 0, by what the element itself is
    container: int  # the nearest container: itself or above
    link: bool
    good: bool


#: Left out with all below; left out unless the main text is below; left out by word if it is mostly links.
ALWAYS, BY_WORD, BY_LINKS = 2, 1, 3


class Chunk(NamedTuple):
    element: int
    block: int
    text: str


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(raw)} if raw.strip(" /\n\t\r") else {}


class Page:
    """Elements and text of a page, read in one pass; unclosed and stray tags are mended as browsers do."""

    def __init__(self, html: str):
        self.elements = [Element(-1, "", "", 0, 0, False, False)]
        self.ends = [0]  # after the last element below
        self.chunks: list[Chunk] = []
        self.block = 0
        self.open = [0]
        self.marks: list[int] = []  # article and main, but those of comments and the like
        self._sums: tuple[list[int], list[int]] | None = None
        self._paths = [""]
        self.opened: Counter[str] = Counter()  # open elements of a name
        self.bars: list[int] = []  # places in ``open`` of what a start tag may close or may not pass
        self._read(html)
        self._pop_to(1)
        self.ends[0] = len(self.elements)
        self.left_out = self._left_out()

    def _read(self, html: str) -> None:
        """Tags and text in order. What follows the last ">" holds no tag, so no search runs to the page's end again and again."""
        text, at, last = 0, html.find("<"), html.rfind(">") + 1
        while 0 <= at:
            m = _TOKEN.match(html, at) if at < last or html.startswith("<!--", at) else None
            tag = None
            if not m and at < last:
                tag = m = _TAG.match(html, at, min(last, at + LONGEST_TAG)) or _BARE_TAG.match(html, at, last)
            if not m:
                at = html.find("<", at + 1)
                continue
            if at > text:
                self._text(html[text:at])
            text = m.end()
            if tag:
                name = tag["tag"].lower()
                if tag["end"]:
                    self._close(name)
                else:
                    self._start(name, tag["attrs"])
            at = html.find("<", text)
        if text < len(html):
            self._text(html[text:])

    def _left_out(self) -> bytearray:
        """For each element whether it is left out, by itself or by one above.

        One left out by a word or as a form stays in where it holds the main text: the only
        main or article, or else, or if it is named as content too, most of the page's text. A page is never
        left out whole for words.
        """
        own = [e.left_out for e in self.elements]
        if BY_LINKS in own:
            chars = [[0] * (len(own) + 1) for _ in range(2)]
            for c in self.chunks:
                chars[self.elements[c.element].link][c.element + 1] += len(c.text.strip())
            plain, links = (list(accumulate(x)) for x in chars)
            for e, x in enumerate(own):
                if x == BY_LINKS:
                    end = self.ends[e]
                    own[e] = BY_WORD if links[end] - links[e] > plain[end] - plain[e] else 0
        out = self._spread([x == ALWAYS for x in own])
        if BY_WORD not in own:
            return out
        before = [0] * (len(own) + 1)
        for c in self.chunks:
            if not out[c.element]:
                before[c.element + 1] += len(c.text.strip())
        before = list(accumulate(before))

        def size(e: int) -> int:
            return before[self.ends[e]] - before[e]

        def words_above(e: int) -> list[int]:
            found = []
            while e > 0:
                if own[e] == BY_WORD:
                    found.append(e)
                e = self.elements[e].parent
            return found[::-1]

        words = [e for e, x in enumerate(own) if x == BY_WORD and not out[e]]
        marks = [e for e in self.marks if not out[e] and size(e)]
        n_above = [0] * len(own)
        for e, x in enumerate(own):
            n_above[e] = (x == BY_WORD) + (n_above[self.elements[e].parent] if e else 0)
        stay: set[int] = set()
        for tag in ("main", "article"):
            of = [e for e in marks if self.elements[e].tag == tag]
            if least := min((n_above[e] for e in of), default=0):
                stay.update(x for e in of for x in words_above(e)[:least])
        stay.update(e for e in words if 2 * size(e) > before[-1] and (not marks or self.elements[e].good))
        while True:
            left = self._spread([x == ALWAYS or x == BY_WORD and e not in stay for e, x in enumerate(own)])
            if not before[-1] or any(not left[c.element] and c.text.strip() for c in self.chunks):
                return left
            stay.add(max((e for e in words if e not in stay and not left[self.elements[e].parent]), key=size))

    def _spread(self, own: list[bool]) -> bytearray:
        """The elements of ``own`` and all below them."""
        out = bytearray(own)
        for k, e in enumerate(self.elements):
            if k and out[e.parent]:
                out[k] = 1
        return out

    def _text(self, text: str) -> None:
        self.chunks.append(Chunk(self.open[-1], self.block, text))

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            gone = self.open.pop()
            tag = self.elements[gone].tag
            self.ends[gone] = len(self.elements)
            self.block += tag in BLOCKS
            self.opened[tag] -= 1
        while self.bars and self.bars[-1] >= place:
            self.bars.pop()

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            return self._text(" ")
        for place in reversed(self.bars):
            above = self.elements[self.open[place]].tag
            if tag in CLOSED_BY.get(above, ()):
                self._pop_to(place)
                break
            if above in CONTAINERS and above not in ("tr", "tbody"):
                break
        if tag in BLOCKS:
            self.block += 1
        if tag in VOID or tag == "math" and raw.endswith("/"):
            return None
        up, attrs = self.elements[self.open[-1]], _attributes(raw)
        classes = attrs.get("class", "").split()
        words = {w.lower() for c in [*classes, attrs.get("id", "")] for w in _WORDS.findall(c)}
        by_word, in_article = bool(words & LEFT_OUT_WORDS), self.opened["article"] + self.opened["main"] > 0
        # a label outside a form is a word of its sentence, a header in an article has the headline
        of_text = tag == "label" and not self.opened["form"] + self.opened["fieldset"] or tag == "header" and in_article
        if (tag in LEFT_OUT and tag != "form" and not of_text or attrs.get("role", "").lower() in LEFT_OUT_ROLES or "hidden" in attrs
                or attrs.get("aria-hidden") == "true"):
            out = ALWAYS
        elif tag == "form" or by_word and tag not in NEVER_BY_CLASS and tag not in HEADINGS:
            out = BY_LINKS if in_article and tag != "form" and not words & (LEFT_OUT_WORDS - SOFT_WORDS) else BY_WORD
        else:
            out = BY_LINKS * (tag == "header" and in_article)
        name = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
        n = len(self.elements)
        holds = tag in CONTAINERS
        self.elements.append(Element(self.open[-1], tag, name, out, n if holds else up.container, up.link or tag == "a",
                                     tag in ("article", "main") or bool(words & GOOD_WORDS)))
        if tag in ("article", "main") and not by_word:
            self.marks.append(n)
        self.ends.append(n + 1)
        if holds or tag in CLOSED_BY:
            self.bars.append(len(self.open))
        self.open.append(n)
        self.opened[tag] += 1
        return None

    def _close(self, tag: str) -> None:
        if self.opened[tag] > 0:
            place = len(self.open) - 1
            while self.elements[self.open[place]].tag != tag:
                place -= 1
            self._pop_to(place)

    def path(self, element: int) -> str:
        """Names of the block elements from the page to this one. Each is made once, from the one above it."""
        for e in self.elements[len(self._paths):]:
            above = self._paths[e.parent]
            if e.tag in BLOCKS:
                if len(above) > LONGEST_PATH:
                    above = "#" + hashlib.md5(above.encode("utf-8", "surrogatepass")).hexdigest()
                above = f"{above}>{e.name}" if above else e.name
            self._paths.append(above)
        return self._paths[element]

    def scores(self) -> dict[int, int]:
        """Points of containers: characters of text outside links that stand in them, half of those one container below, a quarter two below."""
        points: dict[int, int] = defaultdict(int)
        for c in self.chunks:
            e = self.elements[c.element]
            if self.left_out[c.element] or not (n := len(c.text.strip())):
                continue
            n, at = (-2 * n if e.link else 4 * n), e.container
            for share in (4, 2, 1):
                points[at] += n * share * (3 if self.elements[at].good else 2)
                if at == 0:
                    break
                at = self.elements[self.elements[at].parent].container
        return {k: v for k, v in points.items() if v > 0}

    def sums(self) -> tuple[list[int], list[int]]:
        """Characters of text outside links, and in links, of all elements before each one; what is left out does not count."""
        if not self._sums:
            own = [[0] * (len(self.elements) + 1) for _ in range(2)]
            for c in self.chunks:
                if not self.left_out[c.element]:
                    own[self.elements[c.element].link][c.element + 1] += len(c.text.strip())
            self._sums = list(accumulate(own[0])), list(accumulate(own[1]))
        return self._sums

    def size(self, element: int) -> tuple[int, int]:
        """Characters of text outside links and in links below an element."""
        (plain, links), end = self.sums(), self.ends[element]
        return plain[end] - plain[element], links[end] - links[element]

    def raised(self, element: int) -> tuple[int, tuple[int, ...]]:
        """The outermost good container above an element, and the lists of links in it that are no main text.

        Each step up takes all that it adds. Where that is mostly links, containers that
        are mostly links stay out; where nothing else is added, the step is not taken.
        """
        at, without, up = element, (), self.elements[element].parent
        while up > 0:
            e = self.elements[up]
            if e.good and e.tag in CONTAINERS and e.tag not in ("html", "body"):
                plain, links = (a - b for a, b in zip(self.size(up), self.size(at), strict=True))
                if links > plain:
                    lists = self._link_lists(up, at)
                    for k in lists:
                        gone = self.size(k)
                        plain, links = plain - gone[0], links - gone[1]
                    if links >= plain:
                        break
                    without += lists
                at = up
            up = e.parent
        return at, without

    def _link_lists(self, element: int, inner: int) -> tuple[int, ...]:
        """The outermost containers below ``element`` and beside ``inner`` that are mostly links."""
        lists, k, end = [], element + 1, self.ends[element]
        while k < end:
            plain, links = self.size(k)
            if k == inner or links > plain and self.elements[k].tag in CONTAINERS and not k < inner < self.ends[k]:
                lists += [k] * (k != inner)
                k = self.ends[k]
            else:
                k += 1
        return tuple(lists)

    def best(self, points: dict[int, int]) -> tuple[int, tuple[int, ...]]:
        """The container of most points, raised."""
        return self.raised(max(sorted(points), key=points.__getitem__))

    def main(self, found: list[int], best: tuple[int, tuple[int, ...]]) -> str:
        """Text of containers, raised, in the order of the page, without the lists of links that raising leaves out."""
        raised = {self.raised(e) for e in found}
        tops = {e for e, _ in raised}
        without = {k for _, lists in raised | ({best} if best[0] in tops else set()) for k in lists}
        inside = bytearray(len(self.elements))
        for some, value in ((tops, 1), (without, 0), ([e for e in found if any(k <= e < self.ends[k] for k in without)], 1)):
            for e in some:
                inside[e:self.ends[e]] = bytes([value]) * (self.ends[e] - e)
        return self.text(inside)

    def text(self, inside: bytearray | None = None) -> str:
        """Blocks of the elements ``inside`` (all) that are not left out: references decoded, white space one space, one line each."""
        lines: list[str] = []
        parts: list[str] = []
        block = -1
        for c in self.chunks:
            if (inside is None or inside[c.element]) and not self.left_out[c.element]:
                if c.block != block and parts:
                    lines.append(" ".join(unescape("".join(parts)).split()))
                    parts = []
                block = c.block
                parts.append(c.text)
        lines.append(" ".join(unescape("".join(parts)).split()))
        return "\n".join(x for x in lines if x)


def host_of(url: str | None) -> str:
    """Host of a URL in lower case, without user, port and www; empty if it has none."""
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", (url or "").strip())
    host = m[1].rpartition("@")[2].split(":")[0].lower() if m else ""
    return host.removeprefix("www.")


def main_text(html: str | None, paths: list[str] | None) -> str:
    """Main text from the first of ``paths`` with text on this page, else from its best container, else from all of it."""
    page = Page(html or "")
    points = page.scores()
    if not points:
        return page.text()
    best, at = page.best(points), defaultdict(list)
    for e in {*points, best[0]}:
        at[page.path(e)].append(e)
    for p in paths or ():
        if text := page.main(at.get(p, []), best):
            return text
    return page.main([best[0]], best)


def path_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, points, best, pages): votes of each batch of pages for paths; the empty path counts the pages of a host."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
            for u, h in zip(batch.column(0), batch.column(1), strict=True):
                host, page = host_of(u.as_py()), Page(h.as_py() or "")
                points = page.scores()
                sums[host, ""][2] += 1
                if not points:
                    continue
                total = sum(points.values())
                for e, n in points.items():
                    sums[host, page.path(e)][0] += 1000 * n // total
                sums[host, page.path(page.best(points)[0])][1] += 1
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in sums]) for i in (0, 1)] + [pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1, 2)],
                    ["host", "path", "points", "best", "pages"])

    return pages.select(F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(
        vote, "host string, path string, points bigint, best bigint, pages bigint")


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, paths): the paths that are the best one of LEAST_SHARE percent of a host's pages or more, most points first."""
    each = votes.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("points", "best", "pages")])
    each = checkpointed(each)  # a row for each path, read twice; the pages aren't
    pages = each.groupBy("host").agg(F.sum("pages").alias("of"))
    won = each.join(pages, "host").filter((F.col("best") > 0) & (100 * F.col("best") >= LEAST_SHARE * F.col("of")))
    order = F.sort_array(F.collect_list(F.struct((-F.col("points")).alias("p"), "path")))  # at most 100 / LEAST_SHARE
    return won.groupBy("host").agg(F.slice(F.transform(order, lambda x: x["path"]), 1, MOST_PATHS).alias("paths"))


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) in place of ``html``.

    Null or empty html and pages without text give the empty text. Pages without a
    host vote as one. Repeated rows vote and are extracted each; other
    columns stay, input columns named like an output are replaced; an empty table gives an empty table.

    The winning paths are written to a file, so that Spark knows their size and
    broadcasts them only where they are few; else it joins by host and splits hot ones.
    """
    spark = pages.sparkSession
    at = f"{shared_dir(spark)}/paths-{uuid.uuid4().hex}"
    winning_paths(path_votes(pages, url, html)).write.parquet(at)
    winners = spark.read.parquet(at)
    rest = no_name_clash(pages, ["text", "n_chars"]).drop(html)
    row = F.struct(*[F.col(c) for c in rest.columns]) if rest.columns else F.struct(F.lit(0).alias("_"))
    rows = pages.select(row.alias("row"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    bare = F.regexp_extract(F.trim(F.coalesce("u", F.lit(""))), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.substring_index(F.substring_index(bare, "@", -1), ":", 1)), r"^www\.", "")
    joined = rows.withColumn("host", host).join(winners, "host", "left").select("row", "h", "paths")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), p.as_py()) for h, p in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    spec = f"row {joined.schema['row'].dataType.simpleString()}, text string, n_chars bigint"
    return joined.mapInArrow(extract, spec).select("row.*", "text", "n_chars")
