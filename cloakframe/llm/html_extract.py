"""HTML main text by nearest-URL page differencing; markup vetoes, it doesn't replace it.

Each page becomes text lines (blocks). Lines in furniture elements (menus, forms,
adverts ...) go first. Pages of a host stand in the order of their URL paths; on each
side a page meets the nearest one that isn't its copy, their lines are aligned by a
longest common subsequence, and what they share is template and goes.

Lines within an article element stay even if a neighbour has them: quoted passages and
near copies share article text, and the page's text must be whole. A neighbour that
shares most of a page is a copy and says nothing about the template.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blobs, bounded_batches, materialise, parts
from .simhash import numbered

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_MARK = re.compile(r"[>\"']")
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")

# Elements by what HTML says of them.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
FURNITURE = frozenset("nav footer aside form button menu dialog head label fieldset datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup time tt u var wbr img input area base col embed hr link meta param source track br".split())
IMPLIED = frozenset("p li dt dd tr td th option".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in class, id or role that name furniture or the article.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer contentinfo sidebar side complementary aside cookie cookies consent gdpr notice alert popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond reply replies share sharing social related recommended subscribe subscription newsletter signup login search toolbar pagination pager widget skip hidden".split()
)
#: Words that name furniture whatever stands beside them ("reader-comments", "wp-sidebar").
FURNITURE_ALWAYS = frozenset("sidebar navbar navigation breadcrumb breadcrumbs comments disqus cookie cookies consent gdpr advert adverts advertisement advertising masthead contentinfo newsletter popup".split())
#: Furniture on the page, but the article's own within it.
FURNITURE_OUTSIDE = frozenset("header alert".split())
#: Words that may stand beside one of those in a hyphenated name; with any other word ("market-share") it names something else.
BESIDE_WORDS = frozenset(
    "main top bottom left right site page global primary secondary inner outer wrapper wrap container box block area section group list item items link links button buttons icon icons bar panel pane slot unit form field text title body content row column col widget widgets post posts article articles entry entries story stories js is has no the hide show open desktop mobile sticky fixed".split()
)
ARTICLE_WORDS = frozenset("articlebody article main post entry story content".split())
#: Share of a page's characters beyond which a neighbour counts as its copy.
COPY = 0.8

OTHER, ARTICLE, GONE = 0, 1, 2


class Tags:
    """The tags of a page, one after the other, in time linear in its length.

    A tag ends at the first > outside quotes; a quote that never closes is a character. A page may have one tag
    that would reach its end so; that is text, and the tags after it end at their first >.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.plain = False

    def after(self, at: int) -> tuple[int, int, str | None, str] | None:
        """Start, end, name (with its slash; none for comments and declarations) and attributes of the next tag from at on."""
        page = self.page
        while 0 <= (at := page.find("<", at)) < self.last[">"] or at >= 0 and page.startswith("<!--", at):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), None, ""
            if page.startswith(("<!", "<?"), at):
                return at, page.index(">", at) + 1, None, ""
            name = _NAME.match(page, at + 1)
            end = self._end(name.end()) if name else -1
            if end >= 0:
                return at, end + 1, name[0], page[name.end() : end]
            at += 1
        return None

    def _end(self, at: int) -> int:
        if self.plain:
            return self.page.find(">", at)
        while mark := _MARK.search(self.page, at):
            at = mark.start()
            if mark[0] == ">":
                return at
            at = self.page.index(mark[0], at + 1) + 1 if at < self.last[mark[0]] else at + 1
        self.plain = True
        return -1


@dataclass
class Line:
    text: str
    place: int
    article: int


def _kind(name: str, attributes: str, in_article: bool) -> int:
    if name in FURNITURE or (name == "header" and not in_article):
        return GONE
    kind = ARTICLE if name in ("article", "main") else OTHER
    if attributes:
        for key, a, b, c in _NAMED.findall(attributes):
            key, written = key.lower(), a or b or c
            value = written.lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return GONE
            if key in ("class", "id", "role", "itemprop"):
                for token in written.split():
                    words = set(_WORD.findall(_CAPITAL.sub("-", token).lower()))
                    token = token.lower()
                    named = words & FURNITURE_ALWAYS or (words & FURNITURE_WORDS and words <= FURNITURE_WORDS | BESIDE_WORDS)
                    if named and not (in_article and words & FURNITURE_OUTSIDE) and not (kind == ARTICLE and not in_article):
                        return GONE
                    if token in ARTICLE_WORDS or (len(words) > 1 and words & ARTICLE_WORDS and words & {"content", "body", "text", "main"}):
                        kind = ARTICLE
    return kind


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, without raw-text elements; article numbers the outermost article element."""
    out: list[Line] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, int]] = []
    place, article, n_articles = OTHER, 0, 0
    at = 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append(Line(text, place, article))

    def pop(to: int) -> None:
        nonlocal place, article
        _, place, article = stack[to]
        for element, _, _ in stack[to:]:
            n_open[element] -= 1
        del stack[to:]

    tags = Tags(page)
    n_open: Counter[str] = Counter()
    while True:
        tag = tags.after(at)
        start, end, name, attributes = tag if tag else (len(page), len(page), None, "")
        if start > at:
            buffer.append(html.unescape(page[at:start]))
        at = end
        if tag is None:
            break
        if name is None:
            continue
        closing, name = name[0] == "/", name.lstrip("/").lower()
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                at = at or len(page)
                if name not in ("svg", "math"):
                    buffer.append(" ")
            continue
        if name in INLINE:
            if name in ("br", "hr"):
                buffer.append(" ")
            continue
        if name != "span":
            flush()
        if closing:
            if n_open[name]:
                flush()
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in ("body", "html"):
            if stack:
                pop(0)
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        elif name in IMPLIED:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] not in IMPLIED:
                    break
        if attributes.rstrip().endswith("/"):
            continue
        kind = _kind(name, attributes, article > 0)
        if kind == GONE and name == "span":
            flush()
        stack.append((name, place, article))
        n_open[name] += 1
        if kind == GONE or place == GONE:
            place = GONE
        elif kind == ARTICLE:
            if not article:
                n_articles += 1
                article = n_articles
            place = ARTICLE
    flush()
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b.

    Equal lines at both ends belong to one. Between them the rows of the table of lengths are
    integers, a bit for each place of b, so a step over all of b is an addition; repeated lines cost no
    more than others. Every so many rows one is kept, and those between are made again on the way back.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mine, other = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[int, int] = {}
    for j, line in enumerate(other):
        where[line] = where.get(line, 0) | 1 << j
    mine = [(i, where[x]) for i, x in enumerate(mine) if x in where]
    full = (1 << len(other)) - 1

    def rows_from(row: int, some: list[tuple[int, int]]) -> list[int]:
        out = [row]
        for _, match in some:
            own = row & match
            row = ((row + own) | (row - own)) & full
            out.append(row)
        return out

    step = max(1, math.isqrt(len(mine)))
    kept, row = [full], full
    for k in range(0, len(mine), step):
        row = rows_from(row, mine[k : k + step])[-1]
        kept.append(row)
    middle = []
    j = len(other) - 1
    for k in range(len(kept) - 2, -1, -1):
        rows = rows_from(kept[k], mine[k * step : (k + 1) * step])
        i = len(rows) - 1
        while i > 0 and j >= 0:
            if rows[i] >> j & 1:
                j -= 1
            elif not rows[i - 1] >> j & 1:
                i -= 1
            else:
                middle.append(head + mine[k * step + i - 1][0])
                i, j = i - 1, j - 1
    return [*range(head), *middle[::-1], *range(len(a) - tail, len(a))]


def template_lines(own: list[int], sizes: list[int], other: list[int]) -> list[int] | None:
    """Places of the lines that a page shares with another; none if the other is its copy."""
    most = COPY * sum(sizes)
    common = shared(own, other)
    return None if sum(sizes[i] for i in common) > most else common


def _kept_lines(body: bytes) -> list[Line]:
    return [x for x in lines(body.decode("utf-8", "replace")) if x.place != GONE]


def _parsed(pages: DataFrame) -> DataFrame:
    """row_no and url of pages (row_no, url, html), hashes and sizes of their lines, and which lines are outside articles."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_kept_lines(body) for body in blobs(batch.column(2))]
            hashes = [[xxhash.xxh64_intdigest(x.text) - (1 << 63) for x in page] for page in found]
            sizes = [[len(x.text) for x in page] for page in found]
            outside = [[i for i, x in enumerate(page) if x.place != ARTICLE] for page in found]
            numbers = pa.list_(pa.int32())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, numbers), pa.array(outside, numbers)], ["row_no", "url", "hashes", "sizes", "outside"]
            )

    return pages.select("row_no", "url", "html").mapInArrow(run, "row_no long, url string, hashes array<long>, sizes array<int>, outside array<int>")


def template_places(parsed: DataFrame) -> DataFrame:
    """row_no, compared (neighbours it was aligned with) and gone (places of its lines outside articles that are template) of every page."""
    spark = parsed.sparkSession
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    order = ["host", "path", "url", "row_no"]
    placed = parsed.withColumns({"host": host, "path": path}).select(*order, "hashes", "sizes", F.xxhash64("hashes", F.size("hashes")).alias("key"))
    rows = _counted(placed.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order), F.lit(1), "place")
    before = rows.select((F.col("place") + 1).alias("place"), F.col("host").alias("host_b"), F.col("key").alias("key_b"))
    starts = rows.select("place", "host", "key").join(before, "place", "left").select("place", (~F.coalesce((F.col("host") == F.col("host_b")) & (F.col("key") == F.col("key_b")), F.lit(False))).cast("long").alias("starts"))
    rows = rows.join(starts, "place").repartitionByRange(parts(spark), "place").sortWithinPartitions("place")
    rows = _counted(rows, F.col("starts"), "entry")
    # Pages with the same lines are one entry, and are compared once.
    entries = rows.where("starts = 1").select("entry", "host", "hashes", "sizes")
    todo = materialise(entries.select("entry", "host", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [template_lines(r["hashes"], r["sizes"], r["other"]) for r in batch.select(["hashes", "sizes", "other"]).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(gone, pa.list_(pa.int32()))], ["entry", "side", "k", "gone"])

    found = None
    done, upto = 0, 1
    while todo.limit(1).count():
        steps = todo.withColumn("k", F.explode(F.sequence(F.lit(done + 1), F.lit(upto))))
        near = entries.select(F.col("entry").alias("near"), F.col("host").alias("host_n"), F.col("hashes").alias("other"))
        pairs = steps.join(near, (F.col("entry") + F.col("side") * F.col("k") == F.col("near")) & (F.col("host") == F.col("host_n")))
        pairs = pairs.join(entries.select("entry", "hashes", "sizes"), "entry").select("entry", "side", "k", "hashes", "sizes", "other")
        tried = pairs.mapInArrow(compared, "entry long, side int, k int, gone array<int>")
        best = tried.groupBy("entry", "side").agg(F.min_by("gone", F.when(F.col("gone").isNotNull(), F.col("k"))).alias("gone"), F.max("k").alias("far"))
        best = materialise(best)
        some = best.where("gone is not null").select("entry", "gone")
        found = some if found is None else found.unionAll(some)
        todo = materialise(todo.join(best.where(f"gone is null and far = {upto}").select("entry", "side"), ["entry", "side"], "left_semi"))
        done, upto = upto, 4 * upto
    ours = rows.select("row_no", "entry").join(parsed.select("row_no", "outside"), "row_no")
    if found is None:
        return ours.select("row_no", F.lit(0).cast("long").alias("compared"), F.array().cast("array<int>").alias("gone"))
    told = found.groupBy("entry").agg(F.count("*").alias("compared"), F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    joined = ours.join(told, "entry", "left")
    gone = F.array_intersect("outside", F.coalesce("gone", F.array().cast("array<int>")))
    return joined.select("row_no", F.coalesce("compared", F.lit(0).cast("long")).alias("compared"), gone.alias("gone"))


def _counted(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """rows, which stand in order over their partitions, written with the running sum of by, from 1 on."""
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sums = sorted(map(tuple, rows.groupBy(part.alias("part")).agg(F.sum(by)).collect()))
    starts, total = [], 0
    for p, n in sums:
        starts.append((p, total))
        total += n
    base = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, base long"))
    own = F.sum(by).over(Window.partitionBy("part").orderBy("at"))
    return materialise(rows.withColumn("part", part).join(base, "part").withColumn(name, F.col("base") + own).drop("part", "base", "at"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages.

    Null and empty pages, and pages of furniture alone, have an empty text. Rows are
    taken one by one, repeated ids or urls included; a null url belongs to a host of
    its own. Pages are ordered by ranges of host, path and whole url; adjacent pages
    with the same lines are one entry, and on each side of a page the nearest entry of
    the host that isn't its copy is found, however far and in whatever range it is. A
    very long page is parsed whole by one task. Other columns are ignored; no rows give
    no rows.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    plain = numbered(plain, "page_id")
    gone = template_places(materialise(_parsed(plain))).where("size(gone) > 0").select("row_no", "gone")
    told = plain.join(materialise(gone), "row_no", "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, places in zip(blobs(batch.column(2)), batch.column(3).to_pylist()):
                drop = set(places or ())
                out.append(" ".join(x.text for i, x in enumerate(_kept_lines(body)) if i not in drop))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return told.mapInArrow(run, "page_id long, url string, text string")
