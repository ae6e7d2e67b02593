"""Main text of web pages: landmarks of the markup, and differencing against the nearest page of the same host.

A page becomes lines, one for each block of text. Lines inside navigation, headers, footers, sidebars, notices, adverts,
forms, comments and other furniture go at once. Every page is then paired with the page of its host whose URL path is
nearest, the lines of both are aligned by a longest common subsequence, and the lines that both share are deleted. Neighbours that share
nearly all of their text, ``NEAR`` of its characters, are addresses of one article: they are one page here, and the walk along the
paths goes on to the next that differs.

Last, a page that marks its main part (``article``, ``main`` or that role) is checked by the mark: lines outside it go, and
shared lines inside it come back, as articles may well have a line in common. Such pages are paired with each other, as the others are.

Pages are dealt out by ranges of (host, path), so a host with a third of all pages is many ranges; the neighbours of the
first and last page of a range come from a table of one row for each range. Digests of lines travel for the pairing, and the lines once,
to the shared places of their page.

Defined cases: a null or empty page, or one without text, gives an empty text. Markup that is cut off is read as far as it
goes. A null or unreadable URL is a page of the host "". A page that is alone on its host is compared with none, and
so are its copies and near copies. If the pages before and after are equally near, the one before is taken. Repeated rows are pages of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import map_texts, text_of
from spanmill.llm.components import components
from spanmill.session import written

#: Share of the characters of two pages that stands in shared lines if both are addresses of one article.
NEAR = 0.9

#: Elements whose text is no part of an article.
FURNITURE = frozenset(
    "nav header footer aside form button select option textarea input label dialog menu menuitem noscript template iframe "
    "object embed svg canvas audio video head title map datalist".split()
)
#: Words in a class or id that mark furniture, whole or as one part between hyphens and underscores.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion "
    "related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(script|style|xmp|plaintext)\b[^>]*+>.*?(?:</\1\b[^>]*+(?:>|\Z)|\Z)"""
    r"""|<(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</?[a-z][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
#: Bits of alignment that are held at once; more is split in halves.
HELD = 1 << 29


def marked(attributes: str) -> bool:
    if not attributes or "=" not in attributes:
        return False
    for found in NAMED.finditer(attributes):
        words = re.split(r"[\s_-]+", (found[1] or found[2] or found[3] or "").lower())
        if not MARKS.isdisjoint(words):
            return True
    return False


def lines(page: str) -> tuple[list[str], list[str], bool]:
    """The lines of the marked main parts, all lines that are no furniture, and whether a main part is marked."""
    free, in_main, has_main = placed_lines(page)
    return [x for x, here in zip(free, in_main) if here], free, has_main


def placed_lines(page: str) -> tuple[list[str], list[bool], bool]:
    """All lines that are no furniture, which of them are in a marked main part, and whether there is one."""
    free: list[str] = []
    in_main: list[bool] = []
    block: list[str] = []
    inside = skipped = 0  # elements open around this place that mark main parts, and furniture
    open_elements: list[tuple[str, int]] = []  # (name, 1 main, -1 furniture, 0 neither) since the first that counts
    has_main = False
    at = 0

    def end_block() -> None:
        text = " ".join("".join(block).split())
        block.clear()
        if text and not skipped:
            free.append(text)
            in_main.append(inside > 0)

    def close(k: int) -> None:
        nonlocal inside, skipped
        for _, kind in open_elements[k:]:
            inside -= kind == 1
            skipped -= kind == -1
        del open_elements[k:]

    for token in TOKEN.finditer(page):
        if token.start() > at:
            block.append(html.unescape(page[at : token.start()]))
        at = token.end()
        name = token[3]
        if name is None:
            continue
        name = name.lower()
        if name in VOID and name not in BLOCKS:
            if name == "br":
                block.append(" ")
            continue
        if name not in BLOCKS and name not in FURNITURE and not marked(token[4]):
            if open_elements and token[2]:
                for k in range(len(open_elements) - 1, -1, -1):
                    if open_elements[k][0] == name:
                        end_block()
                        close(k)
                        break
                    if open_elements[k][0] in BLOCKS:
                        break
            continue
        end_block()
        if token[2]:
            for k in range(len(open_elements) - 1, -1, -1):
                if open_elements[k][0] == name:
                    close(k)
                    break
            continue
        if open_elements and open_elements[-1][0] == "p" and name in BLOCKS:
            close(len(open_elements) - 1)  # a block ends a paragraph that was left open
        if name in VOID:
            continue
        kind = -1 if name in FURNITURE or marked(token[4]) else 1 if name in ("article", "main") or MAIN_ROLE.search(token[4]) else 0
        has_main |= kind == 1 and not skipped
        if kind or open_elements and (name != "p" or open_elements[-1][0] == "p"):
            open_elements.append((name, kind))
            inside += kind == 1
            skipped += kind == -1
    if at < len(page):
        block.append(html.unescape(page[at:]))
    end_block()
    return free, in_main, has_main


def _rows(a: list, b: list) -> list[int]:
    """Bit rows of the alignment: zeros among the first j bits of row i count the common subsequence of a[:i] and b[:j]."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & masks.get(x, 0)
        rows.append((v + u | v - u) & full)
    return rows


def _counts(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _last(a: list, b: list) -> int:
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    return v


def shared(a: list[str], b: list[str]) -> set[int]:
    """The places in ``a`` of a longest common subsequence of both."""
    here, there = set(a), set(b)
    mine = [k for k, x in enumerate(a) if x in there]
    number: dict[str, int] = {}
    x = [number.setdefault(a[k], len(number)) for k in mine]
    y = [number.setdefault(t, len(number)) for t in b if t in here]
    found: set[int] = set()
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            found.add(mine[a0])
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.add(mine[a1])
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > HELD and a1 - a0 > 1:
            half = (a0 + a1) // 2
            ahead = _counts(_last(x[a0:half], y[b0:b1]), b1 - b0)
            behind = _counts(_last(x[half:a1][::-1], y[b0:b1][::-1]), b1 - b0)[::-1]
            cut = b0 + int(np.argmax(ahead + behind))
            todo += [(a0, half, b0, cut), (half, a1, cut, b1)]
            continue
        rows = _rows(x[a0:a1], y[b0:b1])
        i, j = a1 - a0, b1 - b0
        while i and j:
            below = (1 << j) - 1
            if x[a0 + i - 1] == y[b0 + j - 1]:
                i, j = i - 1, j - 1
                found.add(mine[a0 + i])
            elif (rows[i - 1] & below).bit_count() <= j - (j - 1 - (rows[i] & below >> 1).bit_count()):
                i -= 1
            else:
                j -= 1
    return found


def _digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def parsed(pages: DataFrame, page_id: str, url: str, page: str, whole: bool) -> DataFrame:
    """``page_id, url, host, path, content`` and the lines of every page.

    With ``whole`` these are texts in ``lines``, and ``in_main`` says which are in a marked main part (null: none is marked).
    Without, they are digests and ``sizes``. Pages that mark their main part have a host of their own, as they look otherwise;
    ``content`` is a digest of all lines.
    """

    def start():
        def work(texts: pa.Array, *kept: pa.Array) -> list:
            rows: list[list] = [[], [], [], []]
            for t in texts.to_pylist():
                free, in_main, has_main = placed_lines(t)
                digests = [_digest(x) for x in free]
                content = hashlib.blake2b(b"".join(digests), digest_size=16).digest()
                more = (free, in_main if has_main else None) if whole else (digests, [len(x) for x in free])
                for column, value in zip(rows, (has_main, content, *more)):
                    column.append(value)
            return [*kept, *rows]

        return work

    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    inputs = [text_of(page), F.col(page_id).cast("bigint"), F.col(url).cast("string"), host, path]
    kinds = "lines array<string>, in_main array<boolean>" if whole else "lines array<binary>, sizes array<int>"
    schema = f"page_id bigint, url string, host string, path string, marked boolean, content binary, {kinds}"
    read = map_texts(pages, inputs, schema, start, text=0)
    return read.withColumn("host", F.when(F.col("marked"), F.concat("host", F.lit("\n"))).otherwise(F.col("host"))).drop("marked")


def beside(pages: DataFrame) -> DataFrame:
    """``row, host, path`` with the pages ``before`` and ``after`` (host, path, row) in the order of all addresses."""
    order = ["host", "path", "row"]
    dealt = pages.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    one = F.struct(*order)
    ends = dealt.groupBy("part").agg(F.min(one).alias("low"), F.max(one).alias("high"))  # one row for each range
    over = Window.orderBy("part")
    ends = ends.select("part", F.lag("high").over(over).alias("ended"), F.lead("low").over(over).alias("begins"))
    within = Window.partitionBy("part").orderBy(*order)
    near = dealt.select("*", F.lag(one).over(within).alias("before"), F.lead(one).over(within).alias("after"))
    return near.join(F.broadcast(ends), "part").select(
        *order, F.coalesce("before", "ended").alias("before"), F.coalesce("after", "begins").alias("after")
    )


def neighbours(pages: DataFrame) -> DataFrame:
    """``row, other`` from ``row, host, path``: the page of the same host whose path is nearest, of the one before and the one after."""

    def away(other: str) -> Column:
        return F.when(F.col(f"{other}.host") == F.col("host"), F.levenshtein(F.col(f"{other}.path"), F.col("path")))

    before, after = away("before"), away("after")
    other = F.when(after.isNull() | (before <= after), F.when(before.isNotNull(), F.col("before.row"))).otherwise(F.col("after.row"))
    return beside(pages).select("row", other.alias("other"))


def alike(a: list, b: list, a_sizes: list[int], b_sizes: list[int]) -> bool:
    """Whether lines that both have make up ``NEAR`` of the characters of each."""
    both = set(a) & set(b)
    return all(sum(n for x, n in zip(own, sizes) if x in both) >= NEAR * sum(sizes) for own, sizes in ((a, a_sizes), (b, b_sizes)))


def folded(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The heads without near copies of each other, and ``row, rep`` with the head that stands for each.

    Heads that follow each other in the order of addresses are compared; those that are alike become one, and what now
    follows each other is compared again, until no neighbours are alike. Each round has fewer heads.
    """
    whole = heads
    lines_of = lambda row: whole.select(F.col("row").alias(row), F.col("lines").alias(f"{row}_lines"), F.col("sizes").alias(f"{row}_sizes"))
    classes = heads.select("row", F.col("row").alias("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            yield batch.select([0, 1]).filter(pa.array([alike(*side) for side in sides], pa.bool_()))

    while True:
        pairs = beside(heads).where("before.host = host").select(F.col("before.row").alias("a"), F.col("row").alias("b"))
        both = pairs.join(lines_of("a"), "a").join(lines_of("b"), "b").select("a", "b", "a_lines", "b_lines", "a_sizes", "b_sizes")
        links = written(both.mapInArrow(run, "a bigint, b bigint"), "alike")
        if links.isEmpty():
            return heads, classes
        roots = written(components(links), "roots")
        gone = roots.where("node <> root").select(F.col("node").alias("row"))
        heads = written(heads.join(gone, "row", "left_anti"), "heads")
        known = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        classes = written(known.select("row", F.coalesce("root", "rep").alias("rep")), "classes")


def differenced(pages: DataFrame) -> DataFrame:
    """``host, content, shared`` from ``row, host, path, content, lines, sizes``: for each line, whether the nearest page shares it.

    Only for pages of which it shares a line.

    Addresses of a host with the same lines, or nearly the same, are one page here, so none is compared with its own copy.
    """
    own = ["host", "content"]
    first = F.min(F.struct("path", "row")).alias("head")
    heads = pages.where(F.size("lines") > 0).groupBy(*own).agg(first, F.any_value("lines").alias("lines"), F.any_value("sizes").alias("sizes"))
    heads = written(heads.select(*own, "head.path", "head.row", "lines", "sizes"), "distinct")
    distinct, classes = folded(heads)
    partner = classes.join(neighbours(distinct).withColumnRenamed("row", "rep"), "rep").drop("rep").where("other is not null")
    others = heads.select(F.col("row").alias("other"), F.col("lines").alias("other_lines"))
    both = heads.join(partner, "row").join(others, "other").select(*own, "lines", "other_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            masks = []
            for a, b in pairs:
                places = shared(a, b)
                masks.append([k in places for k in range(len(a))] if places else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(masks, pa.list_(pa.bool_()))], names=[*own, "shared"])

    return both.mapInArrow(run, "host string, content binary, shared array<boolean>").where("shared is not null")


def compared(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """As :func:`main_text`, with ``n_shared``, the lines that the nearest page has too, and ``n_kept``, those of them that a mark keeps."""
    read = written(parsed(pages, page_id, url, page, False).withColumn("row", F.monotonically_increasing_id()), "pages")
    found = written(differenced(read), "shared")
    both = parsed(pages, page_id, url, page, True).join(found, ["host", "content"], "left")
    here = lambda k: F.coalesce(F.get("shared", k), F.lit(False))
    differs = F.filter("lines", lambda x, k: ~here(k))
    stays = F.filter("lines", lambda x, k: F.get("in_main", k))
    text = F.array_join(F.when(F.col("in_main").isNull(), differs).otherwise(stays), "\n")
    common = F.coalesce(F.size(F.filter("shared", lambda x: x)), F.lit(0))
    kept = F.coalesce(F.size(F.filter("in_main", lambda x, k: x & here(k))), F.lit(0))
    return both.select(
        "page_id", "url", text.alias("text"), common.cast("bigint").alias("n_shared"), kept.cast("bigint").alias("n_kept")
    ).withColumn("n_chars", F.length("text").cast("bigint"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    return compared(pages, page_id, url, page).select("page_id", "url", "text", "n_chars")
