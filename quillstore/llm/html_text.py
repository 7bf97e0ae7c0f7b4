"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, one for each block of text, each with its evidence: inside an
article or main element, inside an element that is chrome by name or class (menu, header,
footer, sidebar, notice, advert, form, comments), or neither.  Each page is paired with
the page nearest to it by URL path within its host; the two pages are aligned by longest
common subsequence, an article element as one unit, every other line as its own, and what
both pages share is marked.  Of what stands in article and main elements, shared units
before the page's first own unit and behind its last go (teasers, trails, notices of the
site), if the own units hold the most text; if not, the page is a copy or a version of its
neighbour and keeps all.  Nothing goes from inside an article that is not chrome.  Where a
page has neither element, what is neither shared nor chrome is its text; if nothing but
chrome is its own, it is a copy or a part of its neighbour and keeps all but chrome.  Chrome
is deleted whether shared or not: a page whose neighbour has other menus, or that has no
neighbour, keeps none of it.

So a page whose only marked element is one article gives that article, with or without a
neighbour: differencing decides where the tags leave more than one reading.

Only line hashes take part in pairing: the table of pages is sorted by (host, path), so
a host with a third of all pages is spread over many tasks, and each page meets one
neighbour by an equality join on places in that order.

Defined results: a null or empty html has no text; a null url is a host and path of its
own (empty); character references are decoded; white space in a block becomes one space;
repeated rows each get a row, and identical pages are not each other's neighbour.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize

#: Elements whose content is no text.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select button".split())
#: Those that run to the end of the page without an end tag; of the others only the tag goes.
RAW = frozenset(("script", "style"))
#: Elements that are chrome by name; a header inside an article is the article's own.
CHROME = frozenset("nav footer aside form dialog menu".split())
#: Elements that begin and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same kind closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Words in class, id or role that mark chrome.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|footer|menu|modal|nav|navbar|navigation"
    r"|newsletter|notice|popup|promo|related|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|widget|contentinfo|complementary|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: A quote without its mate is a character like others, so a tag always ends and no text is read twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
#: A slash that ends an unquoted value doesn't close the element.
_OPEN_VALUE = re.compile(r"=\s*[^\s\"'>]+/\Z")
ARTICLE, OPEN, CHROME_LINE = 0, 1, 2


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """(text, evidence) of each block, in page order."""
    return [(text, kind) for text, kind, _ in blocks_of(html)]


def blocks_of(html: str | None) -> list[tuple[str, int, int]]:
    """(text, evidence, article) of each block, in page order: article counts the page's outermost article elements, 0 outside them."""
    html, out, parts = html or "", [], []
    stack: list[str] = []
    article = chrome = 0  # depth of the outermost open element of each kind (article or main), 0 if none
    inside = articles = 0  # depth of the outermost open article element, and how many there were
    endless: set[str] = set()  # silent elements without an end tag from here on

    def evidence() -> int:
        return CHROME_LINE if chrome else ARTICLE if article else OPEN

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            out.append((text, evidence(), articles if inside else 0))
        parts.clear()

    def close(depth: int) -> None:
        """Close the elements from ``depth`` (counted from 1) on."""
        nonlocal article, chrome, inside
        del stack[depth - 1 :]
        if article >= depth:
            article = 0
        if inside >= depth:
            inside = 0
        if chrome >= depth:
            chrome = 0

    at = 0
    for token in _TOKEN.finditer(html):
        start = token.start()
        if start < at:
            continue
        parts.append(html[at:start])
        at = token.end()
        closing, name = token.group(1), (token.group(2) or "").lower()
        if not name:
            continue
        if closing:
            if name in BLOCKS:
                flush()
            if name in stack:
                depth = len(stack) - stack[::-1].index(name)
                if any(x in BLOCKS for x in stack[depth - 1 :]):
                    flush()
                close(depth)
            continue
        if name in BLOCKS:
            flush()
        if name in SILENT:
            if name not in RAW and token.group(3).endswith("/") and not _OPEN_VALUE.search(token.group(3)):
                continue
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(html, at)
            if not end:
                endless.add(name)
            if end or name in RAW:
                at = end.end() if end else len(html)
            continue
        if name in VOID or token.group(3).endswith("/"):
            continue
        if name in SELF_CLOSING and stack and name == stack[-1]:
            close(len(stack))
        stack.append(name)
        depth = len(stack)
        if not article and name in ("article", "main"):
            article = depth
        if not inside and name == "article":
            inside, articles = depth, articles + 1
        if not chrome:
            marked = any(MARKS.search(value.strip("\"'")) for _, value in _ATTRIBUTE.findall(token.group(3))) if token.group(3) else False
            if name in CHROME or (name == "header" and not article) or (marked and name not in ("html", "body", "article", "main")):
                chrome = depth
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    Equal beginnings and ends are taken first, and lines that only one side has are left
    out; what is left is halved until it is small (see ``_common``).
    """
    a, b = 0, 0
    while a < min(len(own), len(other)) and own[a] == other[a]:
        a += 1
    while b < min(len(own), len(other)) - a and own[-1 - b] == other[-1 - b]:
        b += 1
    found = {*range(a), *range(len(own) - b, len(own))}
    both = set(own[a : len(own) - b]) & set(other[a : len(other) - b])
    x = [i for i in range(a, len(own) - b) if own[i] in both]
    y = [other[j] for j in range(a, len(other) - b) if other[j] in both]
    found.update(x[i] for i in _common([own[i] for i in x], y))
    return found


#: Cells of a table of lengths that is kept whole.
_CELLS = 1 << 18


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Of ``x`` with each beginning of ``y``, the length of the longest common subsequence; a bit for each line of ``y``."""
    at: dict[int, list[int]] = {}
    for j, line in enumerate(y):
        at.setdefault(line, []).append(j)

    @lru_cache(16)  # made when asked for: all of them would take lines times lines
    def places(line: int) -> int:
        own = at.get(line, ())
        if len(own) < 8:
            return sum(1 << j for j in own)
        bits = np.zeros(len(y), bool)
        bits[own] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    full = (1 << len(y)) - 1
    row = full  # a zero bit is a step of the length
    for line in x:
        match = row & places(line)
        row = (row + match | row - match) & full
    bits = np.frombuffer(row.to_bytes((len(y) + 7) // 8, "little"), np.uint8)
    return np.append(0, np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(y)].astype(np.int64)))


def _common(x: list[int], y: list[int]) -> list[int]:
    """Places in ``x`` of a longest common subsequence with ``y``, by halving ``x``: memory in proportion to the lines."""
    out: list[int] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= _CELLS or b - a == 1:
            out += (a + i for i in _table(x[a:b], y[c:d]))
            continue
        middle = (a + b) // 2
        total = _lengths(x[a:middle], y[c:d]) + _lengths(x[middle:b][::-1], y[c:d][::-1])[::-1]
        cut = c + int(total.argmax())
        todo += [(a, middle, c, cut), (middle, b, cut, d)]
    return out


def _table(x: list[int], y: list[int]) -> list[int]:
    """The same for short lists, or one line, by a whole table of lengths."""
    if len(x) == 1:
        return [0] if x[0] in y else []
    target = np.array(y)
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        take = np.where(target == x[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(np.append(take, 0)[::-1])[::-1][:-1]
    found, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            found.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return found


def units(lines: list[tuple[str, int, int]]) -> list[list[int]]:
    """Places of the lines of each unit that differencing decides on: an article element but for its chrome, any other line alone."""
    out: list[list[int]] = []
    articles: dict[int, list[int]] = {}
    for i, (_, kind, article) in enumerate(lines):
        if kind == ARTICLE and article in articles:
            articles[article].append(i)
            continue
        out.append([i])
        if kind == ARTICLE and article:
            articles[article] = out[-1]
    return out


def main_text(lines: list[tuple[str, int, int]], shared: set[int]) -> str:
    """The text of articles and main elements but for shared units around the page's own, or without such elements the lines that are neither chrome nor shared."""
    parts = units(lines)
    marked = [u for u, places in enumerate(parts) if lines[places[0]][1] == ARTICLE]
    if not marked:
        free = [u for u, places in enumerate(parts) if lines[places[0]][1] == OPEN]
        return " ".join(lines[parts[u][0]][0] for u in [u for u in free if u not in shared] or free)
    size = {u: sum(len(lines[i][0]) for i in parts[u]) for u in marked}
    own = [u for u in marked if u not in shared]
    if 2 * sum(size[u] for u in own) > sum(size.values()):
        marked = [u for u in marked if own[0] <= u <= own[-1]]
    return " ".join(lines[i][0] for i in sorted(i for u in marked for i in parts[u]))


def line_hashes(lines: list[tuple[str, int, int]]) -> list[int]:
    """Of all units of a page (no line holds a line feed)."""
    return [xxhash.xxh64_intdigest("\n".join(lines[i][0] for i in places)) - (1 << 63) for places in units(lines)]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) without scheme, port, query and fragment."""
    rest = (url or "").split("#")[0].split("?")[0]
    rest = rest.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    return host.rsplit("@", 1)[-1].split(":")[0].lower(), "/" + path.rstrip("/")


#: Pages that one part of the sorted table holds, about.
PART_PAGES = 200_000


def _depth(path: str, other: str) -> Column:
    """How many leading segments two paths share."""
    a, b = F.split(path, "/"), F.split(other, "/")
    least = F.least(F.size(a), F.size(b))
    equal = F.transform(F.sequence(F.lit(1), least), lambda i: F.get(a, i - 1) == F.get(b, i - 1))
    first = F.array_position(equal, False)
    return F.when(first > 0, first - 1).otherwise(least)


def neighbours(pages: DataFrame) -> DataFrame:
    """(key, own, other): hashes of the units of each distinct page and of the page nearest to it by path within its host.

    The sorted table is written, so places are settled; the nearest page is the one
    before or after, whichever shares more of the path, the one before if both share as much.
    """
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            hashes = [line_hashes(blocks_of(h)) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([u[0] for u in urls], pa.string()), pa.array([u[1] for u in urls], pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
                ["key", "host", "path", "own"],
            )

    light = pages.select("key", "url", "html").mapInArrow(run, "key binary, host string, path string, own array<long>")
    light = materialize(light.dropDuplicates(["key"]), "lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-light.count() // PART_PAGES))
    placed = light.repartitionByRange(parts, "host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    # Places go up by one inside a partition; the first of one follows the last of the one before.
    part = F.shiftright("place", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.max("place").alias("last")).orderBy("part").collect()  # one row for each partition
    after = {(b["part"] << 33): a["last"] for a, b in zip(ends, ends[1:])}
    before = F.col("place") - 1
    urls = placed.select("place", "host", "path")
    if after:
        crossings = spark.createDataFrame(list(after.items()), "at long, crossed long")
        urls = urls.join(F.broadcast(crossings), urls.place == crossings["at"], "left").drop("at")
        before = F.coalesce("crossed", before)
    urls = urls.select("place", "host", "path", before.alias("before"))
    last = urls.select(F.col("place").alias("before"), F.col("host").alias("last_host"), F.col("path").alias("last_path"))
    coming = urls.select(F.col("before").alias("place"), F.col("place").alias("after"), F.col("host").alias("next_host"), F.col("path").alias("next_path"))
    beside = urls.join(last, "before", "left").join(coming, "place", "left")
    has_last, has_next = F.coalesce(F.col("last_host") == F.col("host"), F.lit(False)), F.coalesce(F.col("next_host") == F.col("host"), F.lit(False))
    go_on = has_next & (~has_last | (_depth("path", "next_path") > _depth("path", "last_path")))
    nearest = beside.select("place", F.when(go_on, F.col("after")).when(has_last, F.col("before")).alias("near"))
    paired = placed.select("key", "own", "place").join(nearest, "place")
    other = placed.select(F.col("place").alias("near"), F.col("own").alias("other"))
    # Pages alone in their host don't meet in the join, where they would all have the same key.
    alone = paired.where("near IS NULL").select("key", "own", F.lit(None).cast("array<long>").alias("other"))
    return paired.where("near IS NOT NULL").join(other, "near").select("key", "own", "other").union(alone)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    arrow_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parts = [F.coalesce(F.concat(F.lit("\0"), F.col(c).cast("string")), F.lit("")) for c in ("page_id", "url")]
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(*parts, F.coalesce(F.concat(F.lit("\0\0"), "html"), F.lit(""))))))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(shared_lines(own or [], other or [])) for own, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["key", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(blocks_of(h), set(d or ())) for h, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    shared = neighbours(rows).mapInArrow(difference, "key binary, shared array<int>")
    joined = rows.join(shared, "key", "left").select("page_id", "url", "html", "shared")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
