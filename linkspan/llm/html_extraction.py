"""HTML extraction by nearest-URL page differencing.

Pages become lines, one for each block, with a zone: content (within an article, main or the like),
plain, or chrome (menus, headers, footers, sidebars, notices, adverts, forms, reader comments and
hidden elements). Within each host the different pages are sorted by URL path, and each is held
against the neighbour that shares more leading path segments; pages of equal lines stand in for one
another. The lines of both are aligned by a longest common subsequence, and what both share is the
template.

The difference decides what stays: plain lines that the neighbour shares go, and so do content
elements of which every line is shared (a teaser, a notice). Of a content element that differs
somewhere all lines stay, for an article may quote what its neighbour quotes. Elements and class names
are there for what differencing cannot tell: chrome that differs from page to page goes by its
element. Where nothing but chrome differs, the neighbour is a copy: content elements stay whole, and
plain lines where there is none. An element that is shared whole and holds more text than all that
differs is a copied article beside changing scraps, and stays.

Sorting is by range over (host, path, row), so a hot host is split; the neighbours of the rows where
two ranges meet are found on the driver, two rows a range. Alignment takes hashes of lines only, and
only pages that share a line with their neighbour have marks.

Defined cases: null html is an empty page; a null or relative URL has no host and no neighbour;
equal URLs are neighbours; null ids and repeated rows are rows like any other; further columns are
ignored; an empty table gives an empty result. On a tie in segments the page before is taken.
"""

from __future__ import annotations

import html as entities
import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkspan.llm.common import discard, map_texts, materialise, numbered, small_batches, table

CHROME, PLAIN, CONTENT = 0, 1, 2
#: Lines whose marks (a byte each) are broadcast; beyond, pages are shuffled to them.
BROADCAST_LINES = 20_000_000
#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes template xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new one of the kind, or another block, closes.
LOOSE = frozenset("p li dd dt td th tr option".split())
CHROME_TAGS = frozenset("head nav footer aside form menu dialog button select fieldset object applet canvas audio video search".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_NAMES = frozenset("article content post entry story maincontent articlebody postbody entrycontent postcontent articlecontent storybody".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies "
    "consent disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo related "
    "reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Between the parts of a class name; its first and its last part tell what it is for.
JOINTS = re.compile(r"[^a-z]+")


def _zone(tag: str, attributes: str, zone: int) -> int:
    """The zone that an element opens within a zone."""
    if zone == CHROME or tag in CHROME_TAGS or (tag == "header" and zone != CONTENT):
        return CHROME
    found, chrome = PLAIN, False
    if attributes:
        if HIDDEN.search(attributes):
            return CHROME
        for m in NAMES.finditer(attributes):
            names = (m[2] or m[3] or m[4] or "").lower().split()
            if any(n.replace("-", "").replace("_", "") in CONTENT_NAMES for n in names):
                found = CONTENT
            elif tag not in ("html", "body", "article", "main"):
                parts = [[x for x in JOINTS.split(n) if x] for n in names]
                chrome |= any(x[0] in CHROME_NAMES or x[-1] in CHROME_NAMES for x in parts if x)
        if chrome and found != CONTENT:
            return CHROME
    return CONTENT if tag in CONTENT_TAGS or found == CONTENT and tag != "body" else zone


def parse(page: str | None) -> list[tuple[str, int, int]]:
    """The lines of a page in order: text, zone, and the number of the content element (0 elsewhere)."""
    lines: list[tuple[str, int, int]] = []
    if not page:
        return lines
    piece: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at, element = PLAIN, 0, 0

    def close() -> None:
        if piece:
            line = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if line:
                lines.append((line, zone, element if zone == CONTENT else 0))

    while m := TAG.search(page, at):
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][1] != zone:
                        close()
                    zone = stack[k][1]
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            at = page.find(">", end.end() - 1) + 1 or len(page) if end else len(page)
            continue
        if tag == "br":
            piece.append(" ")
        if tag in BLOCK:
            close()
            while stack and stack[-1][0] in LOOSE and (stack[-1][0] == "p" or tag == stack[-1][0]):
                zone = stack.pop()[1]
        if tag in VOID:
            continue
        inner = _zone(tag, m[3], zone)
        if inner != zone:
            close()
            element += inner == CONTENT
        if tag not in LOOSE or inner != zone:
            stack.append((tag, zone))
        zone = inner
    if at < len(page):
        piece.append(page[at:])
    close()
    return lines


def _hashes():
    """Each page's lines as hashes."""

    def signed(line: str) -> int:
        h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
        return h - (1 << 64) if h >> 63 else h

    return lambda pages: {"hashes": [[signed(t) for t, _, _ in parse(p)] for p in pages]}


def text_of_page(page: str | None, gone: list[bool] | None) -> tuple[str, int, int]:
    """The lines that stay, how many lines the page has, and how many of them its neighbour shares."""
    lines = parse(page)
    gone = gone or [False] * len(lines)
    size: dict[int, int] = {}
    live: dict[int, int] = {}
    for (t, z, e), g in zip(lines, gone, strict=True):
        if z != CHROME:
            size[e] = size.get(e, 0) + len(t)
            if not g:
                live[e] = live.get(e, 0) + len(t)
    elements = size.keys() - {0}
    if live:
        differing = sum(live.values())
        whole = {e for e in elements if e in live or size[e] > differing}
        stays = [t for (t, z, e), g in zip(lines, gone, strict=True) if z != CHROME and (e in whole or e == 0 and not g)]
    else:  # a copy of its neighbour, but for the chrome
        stays = [t for t, z, e in lines if z != CHROME and (e in elements or not elements)]
    return "\n".join(stays), len(lines), sum(gone)


def _texts(joined: DataFrame) -> DataFrame:
    """page_id, url, text, n_lines and n_shared from (page_id, url, html, common)."""
    import pyarrow as pa

    small_batches(joined.sparkSession)
    schema = StructType([joined.schema["page_id"], joined.schema["url"], *StructType.fromDDL("text string, n_lines int, n_shared int").fields])

    def run(batches):
        for batch in batches:
            found = [text_of_page(p, g) for p, g in zip(batch.column("html").to_pylist(), batch.column("common").to_pylist(), strict=True)]
            made = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], names=schema.names)

    return joined.select("page_id", "url", "html", "common").mapInArrow(run, schema)


def _row_lengths(a: list, b: list) -> list[int]:
    """For each j, the length of the longest common subsequence of a and b[:j], by bits of a whole number."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    bits = full
    for x in a:
        if mask := where.get(x, 0):
            u = bits & mask
            bits = ((bits + u) | (bits - u)) & full
    out, n = [0], 0
    for c in reversed(bin(bits | 1 << len(b))[3:]) if b else ():
        n += c == "0"
        out.append(n)
    return out


def shared(a: list, b: list) -> list[bool]:
    """Which members of a belong to one longest common subsequence with b. Memory is linear in the lengths (Hirschberg)."""
    out = [False] * len(a)
    in_b, in_a = set(b), set(a)
    pairs = [(i, x) for i, x in enumerate(a) if x in in_b]
    b = [x for x in b if x in in_a]
    todo = [(pairs, b)]
    while todo:
        p, q = todo.pop()
        while p and q and p[0][1] == q[0]:
            out[p[0][0]] = True
            p, q = p[1:], q[1:]
        while p and q and p[-1][1] == q[-1]:
            out[p[-1][0]] = True
            p, q = p[:-1], q[:-1]
        if not p or not q:
            continue
        if len(p) == 1:
            out[p[0][0]] = p[0][1] in q
            continue
        half = len(p) // 2
        head = _row_lengths([x for _, x in p[:half]], q)
        tail = _row_lengths([x for _, x in reversed(p[half:])], q[::-1])
        cut = max(range(len(q) + 1), key=lambda j: (head[j] + tail[len(q) - j], -j))
        todo += [(p[:half], q[:cut]), (p[half:], q[cut:])]
    return out


def _aligned(pairs: DataFrame) -> DataFrame:
    """uid and, for each of its lines, whether the neighbour shares it."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [shared(a, b) for a, b in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(found, pa.list_(pa.bool_()))], names=["uid", "common"])

    return pairs.select("uid", "own", "other").mapInArrow(run, "uid long, common array<boolean>")


def _segments(a: str, b: str) -> Column:
    """Leading path segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    run = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), (s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n")))
    return run["n"]


def neighbours(keys: DataFrame) -> DataFrame:
    """uid and the uid `near` of its nearest page of the same host, from (uid, host, path)."""
    spark = keys.sparkSession
    dealt = keys.where("host <> ''").repartitionByRange("host", "path", "uid").sortWithinPartitions("host", "path", "uid")
    dealt = materialise(dealt.select("uid", "host", "path", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")))
    w = W.partitionBy("part").orderBy("pos")
    me = F.struct("uid", "host", "path")
    placed = dealt.select("uid", "host", "path", "pos", F.lag(me).over(w).alias("prev"), F.lead(me).over(w).alias("next"))
    ends = placed.where("prev is null or next is null").select("uid", "host", "path", "pos", F.col("prev").isNull().alias("opens"), F.col("next").isNull().alias("closes")).orderBy("pos").collect()
    meet = [(x.uid, y.uid, x.host, x.path, y.host, y.path) for x, y in zip(ends, ends[1:], strict=False) if x.closes and y.opens]
    edge = spark.createDataFrame(meet, "u long, v long, uh string, up string, vh string, vp string")
    before = F.broadcast(edge.select(F.col("v").alias("uid"), F.struct(F.col("u").alias("uid"), F.col("uh").alias("host"), F.col("up").alias("path")).alias("p")))
    after = F.broadcast(edge.select(F.col("u").alias("uid"), F.struct(F.col("v").alias("uid"), F.col("vh").alias("host"), F.col("vp").alias("path")).alias("n")))
    both = placed.join(before, "uid", "left").join(after, "uid", "left").withColumn("prev", F.coalesce("prev", "p")).withColumn("next", F.coalesce("next", "n"))
    left = F.when(F.col("prev.host") == F.col("host"), _segments("path", "prev.path")).otherwise(-1)
    right = F.when(F.col("next.host") == F.col("host"), _segments("path", "next.path")).otherwise(-1)
    near = both.select("uid", F.when(F.greatest(left, right) < 0, None).when(left >= right, F.col("prev.uid")).otherwise(F.col("next.uid")).alias("near"))
    return near.where("near is not null")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, and n_lines and n_shared (lines of the page, and those that its neighbour shares) of every row of pages."""
    url = F.col(url_col).cast("string")
    origin = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    rows = numbered(pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).alias("html")), "uid")
    host, path = (F.coalesce(F.regexp_extract("url", origin, k), F.lit("")) for k in (1, 2))
    hashed = rows.select("uid", F.lower(host).alias("host"), path.alias("path"), "html")
    hashed = map_texts(hashed, "html", ("uid", "host", "path"), _hashes, "hashes array<bigint>")
    digest = F.struct(F.xxhash64("hashes", F.lit(1)).alias("x"), F.xxhash64("hashes", F.lit(2)).alias("y"))
    hashed = materialise(hashed.where("host <> ''").withColumn("digest", digest))
    # pages of equal lines of a host stand in for one another; the first in the order of paths has the neighbour
    page = F.struct("path", "uid")
    first = hashed.groupBy("host", "digest").agg(F.min(page).alias("x")).select("host", "digest", F.col("x.path").alias("path"), F.col("x.uid").alias("uid"))
    first = materialise(first)
    near = neighbours(first.select("uid", "host", "path"))
    own = hashed.select("uid", F.col("hashes").alias("own"))
    pairs = near.join(own, "uid").join(own.select(F.col("uid").alias("near"), F.col("own").alias("other")), "near")
    common = _aligned(pairs).where(F.exists("common", lambda x: x))
    common = materialise(common.join(first.select("uid", "host", "digest"), "uid").select("host", "digest", "common"))
    lines = common.agg(F.sum(F.size("common"))).first()[0] or 0
    side = F.broadcast(common) if lines <= BROADCAST_LINES else common
    marks = materialise(hashed.select("uid", "host", "digest").join(side, ["host", "digest"]).select("uid", "common"))
    # pages are read again rather than kept: beside the marks of their lines, the texts are the bulk
    lines = marks.agg(F.sum(F.size("common"))).first()[0] or 0
    marked = rows.join(F.broadcast(marks) if lines <= BROADCAST_LINES else marks, "uid", "left")
    discard(hashed, first, common)
    return _texts(marked).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
