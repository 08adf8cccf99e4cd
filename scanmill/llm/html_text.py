"""Main text of web pages by differencing each page against its nearest URL.

A page is parsed into lines, one per block, each marked by where it stands: inside an ``article`` or ``main`` container, inside
chrome (menus, headers, footers, asides, forms, adverts, notices, comments, by tag, role or class), or in neither ("open"). Pages
are ordered by host and path; each is paired with its nearest URL of the same host (the longer common path prefix of its two
neighbours, the earlier on ties), the lines of the pair are aligned by longest common subsequence, and shared lines go. The text is
what is left of the container's lines, or else of the open ones.
An article may be published under two URLs: a neighbour is a copy if what the two do not share is nearly nothing of either, in
words. Then the other neighbour decides, and a page with no neighbour but copies stays whole.

Rows and ties: a null or empty page has an empty text. Pages that repeat a URL are neighbours in the order of page_id; pages without
a URL share the host "". Broken markup is read as browsers do in the cases listed at :class:`PageLines`. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices, stored

MAIN, OPEN, CHROME = 0, 1, 2
# fixed values: elements of HTML by their use
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
MUTE = set("script style noscript template iframe svg math object canvas head title textarea select button audio video".split())
CHROME_TAGS = set("nav aside footer form menu dialog header".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe\w*|signup|"
    r"login|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|replies|respond|disqus|"
    r"share|sharing|social|related|recommended|popup|modal|overlay|widget|pagination|pager|skip)(?:$|[\s_\d-])", re.I)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
STOP_AT = {"ul", "ol", "dl", "table", "select", "menu"}
SPACE = re.compile(r"\s+")


class PageLines(HTMLParser):
    """Lines of a page as (place, text).

    An end tag closes what is open inside it and is skipped if nothing of its name is open; a block closes an open
    paragraph; list items, cells and rows close their like; an article closes chrome that was never closed.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.place, self.mute = OPEN, 0
        self.lines: list[tuple[int, str]] = []
        self.parts: list[str] = []

    def _flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                self.lines.append((self.place, text))

    def _pop(self, k: int) -> None:
        """Close everything from position ``k`` of the stack on."""
        if any(tag in BLOCKS for tag, _ in self.stack[k:]):
            self._flush()
        self.mute -= sum(tag in MUTE for tag, _ in self.stack[k:])
        self.place = self.stack[k][1]
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag in BLOCKS:
            if tag in ("article", "main", "body") and self.place == CHROME and not self.mute:
                for k, (open_tag, before) in enumerate(self.stack):
                    if before != CHROME and open_tag in CHROME_TAGS:
                        self._pop(k)
                        break
            self._close_like(tag)
            self._flush()
        self.stack.append((tag, self.place))
        if tag in MUTE:
            self.mute += 1
        elif self.place != CHROME:
            if tag in ("article", "main"):
                self.place = MAIN
            elif tag not in ("html", "body") and self._chrome(tag, dict(attrs)):
                self.place = CHROME

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in ("script", "style"):
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _close_like(self, tag: str) -> None:
        like = CLOSED_BY.get(tag, set()) | {"p"}
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in like:
                self._pop(k)
                return
            if name in STOP_AT or (name in BLOCKS and name not in ("p",) and tag not in CLOSED_BY):
                return

    def _chrome(self, tag: str, attrs: dict) -> bool:
        if tag in CHROME_TAGS and not (tag == "header" and self.place == MAIN):
            return True
        if (attrs.get("role") or "").lower() in CHROME_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
            return True
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        return tag in BLOCKS | {"span", "ins"} and names != " " and bool(CHROME_NAMES.search(names))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                self._pop(k)
                return
            if tag not in BLOCKS and name in BLOCKS:
                return

    def handle_data(self, data):
        if not self.mute:
            self.parts.append(data)

    def read(self, html: str) -> list[tuple[int, str]]:
        self.feed(html)
        self.close()
        self._flush()
        return self.lines


#: cells of a table of matches that is kept whole, a bit each: 32 MB
_CELLS = 1 << 28


def _match_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Row by row of ``a``, a number with bit j clear where the best subsequence grows from ``b[:j]`` to ``b[:j + 1]``."""
    full, where = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row = full
    for x in a:
        met = row & where.get(x, 0)
        row = (row + met | row - met) & full
        yield row


def _grown(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each head of ``b``."""
    row = (1 << len(b)) - 1
    for row in _match_rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``; of lines that repeat, late ones are taken.

    A machine word holds 64 columns of the table, so lines that repeat thousands of times cost no more than others. A table of more
    than ``_CELLS`` is halved where heads and tails of ``b`` add up best, so its memory is bounded as well.
    """
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > _CELLS:
        half = len(a) // 2
        cut = int(np.argmax(_grown(a[:half], b) + _grown(a[half:][::-1], b[::-1])[::-1]))
        return common_subsequence(a[:half], b[:cut]) + [half + k for k in common_subsequence(a[half:], b[cut:])]
    rows, out = list(_match_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def _prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def is_copy(words: list[int], shared: list[int], copy_share: float) -> bool:
    """Whether the lines at ``shared`` hold at least ``copy_share`` of the words."""
    return sum(words[k] for k in shared) >= copy_share * sum(words)


def verdicts(one: dict, two: dict, copy_share: float) -> tuple[int, list[int] | None, list[int] | None]:
    """Length of the common path, and which standing lines either page shares with the other: None for both if they are copies."""
    first = common_subsequence(one["digests"], two["digests"])
    second = common_subsequence(two["digests"], one["digests"])
    near = _prefix(one["path"], two["path"])
    if is_copy(one["words"], first, copy_share) and is_copy(two["words"], second, copy_share):
        return near, None, None
    return near, _standing(one["words"], first), _standing(two["words"], second)


def _standing(words: list[int], shared: list[int]) -> list[int]:
    """Positions of the shared lines among those that stand in the text."""
    out = set(shared)
    return [j for j, k in enumerate(k for k, n in enumerate(words) if n) if k in out]


WALKED = ("row long, gone array<int>, near int, range int, first boolean, last boolean,"
          " host string, path string, words array<int>, digests array<long>")
VERDICTS = "row long, near int, later boolean, gone array<int>"


def _walk(batches: Iterator[pa.RecordBatch], copy_share: float) -> Iterator[pa.RecordBatch]:
    """One range of pages in the order of their URLs: what each page shares with the nearer of its two neighbours that is no copy.

    The first and the last page of the range have a neighbour elsewhere, so they go on with their digests and what the walk found.
    """
    part = TaskContext.get().partitionId()
    schema = pa.schema([("row", pa.int64()), ("gone", pa.list_(pa.int32())), ("near", pa.int32()), ("range", pa.int32()),
                        ("first", pa.bool_()), ("last", pa.bool_()), ("host", pa.string()), ("path", pa.string()),
                        ("words", pa.list_(pa.int32())), ("digests", pa.list_(pa.int64()))])

    def result(page, earlier, later, first, last):
        found = sorted((x for x in (earlier, later) if x and x[1] is not None), key=lambda x: -x[0])
        near, gone = found[0] if found else (None, None)
        out = {"row": page["row"], "gone": gone, "near": near, "range": part, "first": first, "last": last}
        if first or last:
            out |= {c: page[c] for c in ("host", "path", "words", "digests")}
        return out if gone or first or last else None

    page, before, first = None, None, True
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for after in batch.slice(at, 256).to_pylist():
                if page is not None:
                    near, mine, its = verdicts(page, after, copy_share) if page["host"] == after["host"] else (0, None, None)
                    out.append(result(page, before, (near, mine), first, False))
                    before, first = (near, its), False
                page = after
            out = [r for r in out if r]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
    if page is not None:
        yield pa.RecordBatch.from_pylist([result(page, before, None, first, True)], schema)


def shared_lines(ordered: DataFrame, copy_share: float) -> DataFrame:
    """``row, gone`` for the pages that lose lines, from pages in ranges sorted by URL; only the ends of ranges are exchanged."""
    spark = ordered.sparkSession
    walked = stored(ordered.mapInArrow(lambda batches: _walk(batches, copy_share), WALKED), "pages-by-url")
    ends = walked.where("first or last")
    inner = walked.where("not (first or last)").select("row", "gone")
    # at most two rows per range, without their lines
    places = sorted(ends.select("range", "last", "row").collect())
    by_range: dict[int, list[int]] = {}
    for r in places:
        by_range.setdefault(r["range"], []).append(r["row"])
    order = list(by_range.values())
    met = spark.createDataFrame([(a[-1], b[0]) for a, b in zip(order, order[1:])], "one long, two long")
    side = lambda name: ends.select(
        F.col("row").alias(name), F.struct("host", "path", "words", "digests").alias(f"{name}_page"))
    pairs = met.join(side("one"), "one").join(side("two"), "two").where("one_page.host = two_page.host")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                near, mine, its = verdicts(r["one_page"], r["two_page"], copy_share)
                rows += [(r["one"], near, True, mine), (r["two"], near, False, its)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32())))],
                    names=["row", "near", "later", "gone"])

    # a page at the start of its range has its later neighbour inside, one at the end its earlier one
    inside = ends.select("row", "near", F.col("first").alias("later"), "gone")
    heard = pairs.mapInArrow(meet, VERDICTS).unionByName(inside).where("gone is not null")
    outer = heard.groupBy("row").agg(F.min_by("gone", F.struct(-F.col("near"), "later")).alias("gone"))
    return inner.unionByName(outer).where(F.size("gone") > 0)


PARSED = "page_id long, url string, host string, path string, text binary, words array<int>, digests array<long>"


def extract(pages: DataFrame, copy_share: float = 0.95, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page.

    A page is parsed once and its text stored, compressed for the last join. What is ordered is the digests of all lines with the
    words of those that stand in the text (0 for others): by range partitioning on (host, path, page_id), so a host with a third of
    all pages is cut into many ranges. Each range is walked once, and only the pages at its ends are joined with those of the next
    range; nothing gathers a host. A line of the text holds no line feed, so texts are cut into their lines again at the end.
    """
    ready(pages.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "html"):
            texts, words, digests = [], [], []
            for html in rows.column("html").to_pylist():
                got = PageLines().read(html) if html else []
                place = MAIN if any(p == MAIN for p, _ in got) else OPEN
                texts.append(zlib.compress("\n\n".join(t for p, t in got if p == place).encode("utf-8", "replace")))
                words.append([t.count(" ") + 1 if p == place else 0 for p, t in got])
                digests.append([int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for _, t in got])
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) for c in ("page_id", "url", "host", "path")]
                + [pa.array(texts, pa.binary()), pa.array(words, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.int64()))],
                names=["page_id", "url", "host", "path", "text", "words", "digests"])

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"),
        F.col(html_col).cast("string").alias("html"))
    # the number of a row is stored with it, so it stays what it is
    parsed = stored(rows.mapInArrow(parse, PARSED).withColumn("row", F.monotonically_increasing_id()), "page-lines")
    small = parsed.select("row", "host", "path", "page_id", "words", "digests")
    ordered = small.repartitionByRange("host", "path", "page_id", "row").sortWithinPartitions("host", "path", "page_id", "row")
    aligned = shared_lines(ordered, copy_share)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                text = zlib.decompress(packed).decode()
                if gone:
                    out = set(gone)
                    text = "\n\n".join(t for j, t in enumerate(text.split("\n\n")) if j not in out)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    whole = parsed.select("row", "page_id", "url", "text").join(aligned, "row", "left").select("page_id", "url", "text", "gone")
    out = whole.mapInArrow(difference, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
