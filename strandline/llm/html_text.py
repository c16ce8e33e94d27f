"""Main text of web pages by structure and nearest-URL page differencing.

1.  Each page is cut into text lines, one per block element, with white space
    collapsed and character references decoded.  Structure gives every line a
    vote: 1 inside an article or main element; -1 where an element declares
    itself boilerplate (by tag, role, class or id), and outside the body of a
    page that declares one; else 0.  Scripts and styles are no lines.
2.  Pages are sorted by host, URL path and id over range partitions, which split
    a host of any size.  Copies (equal lines) that follow each other on a host
    are one run, and all of a run have the same partner: of the pages directly
    before and after the run, the one whose path shares the longer prefix with
    the run's end beside it (ties: the one before).  The ends of each partition
    are handed to the others, also through partitions that one run fills, so
    pairs do not depend on how the rows were dealt.  Only line hashes travel.
3.  The lines of the two pages are aligned by longest common subsequence.  What
    they share is the host's template: a vote of -1; a line that the partner
    lacks is the page's own: a vote of 1.  A partner that has every line of the
    page says nothing about templates; the other neighbour then serves, or none.
4.  A line stays if its votes add up to more than 0; if they cancel out,
    structure decides, as pages share sentences of their articles and differ in
    their menus and adverts.  So differencing settles the lines of which the
    structure says nothing.  Every page is aligned, and every line gets both votes.
5.  The pages are read again, and only lines that may stay travel, once, to the
    decisions.  Rows that repeat page, url and html lie side by side in the
    order, so they have one decision.

Null html or url count as empty; a page without text has text '' and n_chars 0.
Repeated rows each give a row.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, stored

# Element names.
_RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "xmp"}
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "audio", "video", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
# Words in class, id or role that declare boilerplate.
_HINTS = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary contentinfo consent cookie cookies dialog disqus footer gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices pagination popup promo promoted recommended related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z0-9]+")


def _declared(tag: str, attrs: str, in_body: bool) -> bool:
    """Whether an element says of itself that it is not main text."""
    if tag in _DROPPED or (tag == "header" and not in_body):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and not _HINTS.isdisjoint(_WORD.findall(value)):
            if tag != "article" or not {"comment", "reply"}.isdisjoint(_WORD.findall(value)):
                return True
    return False


def page_lines(html: str | None) -> tuple[list[str], list[int]]:
    """The text lines of a page and the kind of each: 0 plain, 1 declared body, 2 declared boilerplate."""
    lines, kinds, held = [], [], []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, boilerplate from here, body from here, text held before (inline)
    drop, body = 0, 0

    def emit(parts: list[str], dropped: bool) -> None:
        text = " ".join(htmllib.unescape("".join(parts)).split())
        if text:
            lines.append(text)
            kinds.append(2 if dropped else 1 if body else 0)

    def flush() -> None:
        marks = [s[3] for s in stack if s[3] >= 0]
        if marks:  # a block inside an inline advert ends the text around it
            emit(held[: marks[0]], drop > len(marks))
            del held[: marks[0]]
            stack[:] = [(*s[:3], min(s[3], 0)) for s in stack]
        emit(held, drop > 0)
        held.clear()

    def pop() -> None:
        nonlocal drop, body
        tag, a, b, mark = stack[-1]
        if mark >= 0:  # inline boilerplate leaves its block in one piece
            del held[mark:]
        elif a or b or tag in _BLOCK:
            flush()
        stack.pop()
        drop -= a
        body -= b

    at, n, html = 0, len(html or ""), html or ""
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            held.append(html[at:])
            break
        m = _TOKEN.match(html, lt)
        if not m:  # a lone '<'
            held.append(html[at : lt + 1])
            at = lt + 1
            continue
        held.append(html[at:lt])
        at = m.end()
        if m["cdata"] is not None:
            held.append(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[0] in ("article", "main", "body") for s in stack[i + 1 :]) and tag not in _BLOCK:
                        break  # a stray inline end tag closes no article
                    while len(stack) > i:
                        pop()
                    break
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            if not m["attrs"].endswith("/"):
                at = end.end() if end else n
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if tag in _VOID or m["attrs"].endswith("/"):
            continue
        if tag == "p":
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "a", "span", "u", "small"):
                if not any(s[0] == "p" for s in stack):
                    break
                pop()
        if tag in ("article", "main") and drop and not any(
            s[1] and s[0] not in ("nav", "header", "footer", "head", "div", "menu") for s in stack
        ) and not body:  # an unclosed menu or banner does not swallow the article
            open_drop = [s for s in stack if s[1]]
            if all(s[0] in ("nav", "header", "head", "menu") for s in open_drop):
                flush()
                while any(s[1] for s in stack):
                    pop()
        declared = _declared(tag, m["attrs"], body > 0)
        mark = len(held) if declared and tag not in _BLOCK else -1
        stack.append((tag, declared, tag in ("article", "main") and not declared, mark))
        drop += declared
        body += stack[-1][2]
    flush()
    return lines, kinds


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which elements of a are in a longest common subsequence with b (bit-parallel, rows kept)."""
    out = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
        out[x] = True
    shared = set(a[lo:x]) & set(b[lo:y])
    index = [i for i in range(lo, x) if a[i] in shared]
    left, right = [a[i] for i in index], [v for v in b[lo:y] if v in shared]
    for i in _lcs(left, right):
        out[index[i]] = True
    return out


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit j of row i is 0 where the LCS of a[:i] and b grows between b[:j] and b[:j + 1]."""
    places: dict[int, int] = {}
    for j, v in enumerate(b):
        places[v] = places.get(v, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for v in a:
        hit = row & places.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _lcs(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 1 << 30:  # halves, to keep rows of bounded size
        mid = len(a) // 2
        ahead, behind = _lengths(a[:mid], b), _lengths(a[mid:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(ahead + behind))
        return _lcs(a[:mid], b[:cut]) + [mid + i for i in _lcs(a[mid:], b[cut:])]
    rows, out = _rows(a, b), []
    i, j = len(a), len(b) - 1
    while i and j >= 0:
        if rows[i] >> j & 1:  # b[j] adds nothing
            j -= 1
        elif not rows[i - 1] >> j & 1:  # nor does a[i - 1]
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    places: dict[int, int] = {}
    for j, v in enumerate(b):
        places[v] = places.get(v, 0) | (1 << j)
    full = row = (1 << len(b)) - 1
    for v in a:
        hit = row & places.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))])


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path; '' where there is none."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").removesuffix("."), parts.path
    except ValueError:
        return "", url or ""


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def alike(a: tuple, b: tuple) -> bool:
    """Whether two pages (host, path, hashes) are copies on one host."""
    return a[0] == b[0] and a[2] == b[2]


def shared_with_neighbours(before: tuple | None, first: tuple, last: tuple, after: tuple | None) -> list[int]:
    """Indexes of the lines that a run of copies, from page first to last (host, path, hashes), shares with its partner."""
    near = [(p, shared_prefix(p[1], end[1])) for p, end in ((before, first), (after, last)) if p and p[0] == end[0]]
    near.sort(key=lambda p: -p[1])
    for partner, _ in near:
        hit = common_lines(first[2], partner[2])
        if not all(hit):
            return [i for i, h in enumerate(hit) if h]
    return []


def structure_votes(kinds: list[int]) -> list[int]:
    """What the structure says of each line of a page."""
    outside = -1 if 1 in kinds else 0
    return [(outside, 1, -1)[k] for k in kinds]


_ORDER = ["host", "path", "page_id", "th", "rid"]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every page its place in the order, the hashes of its lines and the votes of its structure."""
    import xxhash

    for block in blocks(batches, "html"):
        out = {k: [] for k in ("host", "path", "votes", "hashes")}
        for url, html in zip(block.column("url").to_pylist(), block.column("html").to_pylist(), strict=True):
            lines, kinds = page_lines(html)
            hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in lines]
            for k, v in zip(out, (*url_key(url), structure_votes(kinds), hashes), strict=True):
                out[k].append(v)
        kinds = (pa.string(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.int64()))
        columns = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([block.column("page_id"), block.column("th"), *columns], names=["page_id", "th", *out])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that may stay, and their numbers: a vote of -1 leaves a line 0 at most, and then structure decides."""
    for block in blocks(batches, "html"):
        numbers, lines = [], []
        for html in block.column("html").to_pylist():
            texts, kinds = page_lines(html)
            may = [i for i, v in enumerate(structure_votes(kinds)) if v >= 0]
            numbers.append(may)
            lines.append([texts[i] for i in may])
        columns = [pa.array(numbers, pa.list_(pa.int32())), pa.array(lines, pa.list_(pa.string()))]
        names = ["page_id", "url", "th"]
        yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), *columns], names=[*names, "at", "lines"])


def _sorted_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(partition, row, page) of a sorted partition."""
    for batch in batches:
        for pid, rid, *page in zip(*(batch.column(c).to_pylist() for c in ("pid", "open", "host", "path", "hashes")), strict=True):
            yield pid, rid, tuple(page)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: first (0) and last (1) page of its first run, the page after that (2), the one before its
    last run (3), first (4) and last (5) page of that run; 2 and 3 are missing where one run is all."""
    ends: dict[int, tuple] = {}
    last = pid = None
    for pid, _, page in _sorted_pages(batches):
        if last is None:
            ends[0] = ends[4] = page
        elif not alike(last, page):
            if 2 not in ends:
                ends[1], ends[2] = last, page
            ends[3], ends[4] = last, page
        last = page
    if last is not None:
        ends[5] = last
        ends.setdefault(1, last)
        hosts, paths, hashes = zip(*ends.values(), strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid] * len(ends), pa.int32()), pa.array(list(ends), pa.int32()), pa.array(hosts, pa.string()),
             pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
            names=["pid", "k", "host", "path", "hashes"],
        )


def _edges(ends: dict[int, dict[int, tuple]]) -> dict:
    """What lies before and after each partition: the nearest page, the far end of its run, and the page beyond that."""
    out: dict = {"before": {}, "after": {}}
    for side, pids, (close, far, beyond) in (("before", sorted(ends), (5, 4, 3)), ("after", sorted(ends)[::-1], (0, 1, 2))):
        run = None
        for pid in pids:
            out[side][pid], own = run, ends[pid]
            if beyond in own or not run:
                run = own[close], own[far], own.get(beyond)
            elif alike(run[0], own[close]):  # a run over several partitions
                run = own[close], run[1], run[2]
            else:
                run = own[close], own[far], run[0]
    return out


def _differ(edges: dict):
    """Lines that each page of a sorted partition shares with its partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []  # rows of the run from first to last; before is the page before it
        before = first = last = pid = None

        def done(after: tuple | None) -> Iterator[pa.RecordBatch]:
            shared = [False] * len(first[2])
            for i in shared_with_neighbours(before, first, last, after):
                shared[i] = True
            for i in range(0, len(held), 100):
                ids = pa.array(held[i : i + 100], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([shared] * len(ids), pa.list_(pa.bool_()))], names=["rid", "shared"])
            held.clear()

        for pid, rid, page in _sorted_pages(batches):
            if last is None and edges["before"].get(pid):
                last, first, before = edges["before"][pid]
            if last is None or not alike(last, page):
                if held:
                    yield from done(page)
                before, first = last, page
            held.append(rid)
            last = page
        if held:
            after = edges["after"].get(pid)
            if after and alike(last, after[0]):
                _, last, after = after
            else:
                after = after and after[0]
            yield from done(after)

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    # with the id it tells rows apart that differ in anything
    known = F.xxhash64(F.coalesce("url", F.lit("")), F.lit(0), F.coalesce("html", F.lit("")))
    rows = rows.withColumn("th", known)
    cut = rows.mapInArrow(_cut, "page_id long, th long, host string, path string, votes array<tinyint>, hashes array<long>")
    cut = stored(cut.withColumn("rid", F.monotonically_increasing_id()))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        cut.select(*_ORDER, F.col("rid").alias("open"), "hashes")
        .repartitionByRange(parts, *_ORDER)
        .sortWithinPartitions(*_ORDER)
        .withColumn("pid", F.spark_partition_id())
    )
    ordered = checkpoint(ordered)
    ends: dict = {}  # up to six pages per partition reach the driver
    for r in ordered.mapInArrow(_ends, "pid int, k int, host string, path string, hashes array<long>").collect():
        ends.setdefault(r["pid"], {})[r["k"]] = (r["host"], r["path"], list(r["hashes"]))
    shared = ordered.mapInArrow(_differ(_edges(ends)), "rid long, shared array<boolean>")
    each = cut.select("rid", "page_id", "th", "votes").join(shared, "rid")
    own = F.transform("votes", lambda v, i: v + F.when(F.get("shared", i), -1).otherwise(1))
    stays = lambda v, i: (v > 0) | ((v == 0) & (F.get("votes", i) > 0))
    each = each.withColumn("own", own).select(F.col("page_id").alias("id"), F.col("th").alias("tw"), F.transform("own", stays).alias("stays"))
    each = checkpoint(each.groupBy("id", "tw").agg(F.first("stays").alias("stays")))  # a hot key's rows can then be split
    texts = rows.mapInArrow(_texts, "page_id long, url string, th long, at array<int>, lines array<string>")
    texts = texts.join(each.hint("merge"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("tw")))
    lines = F.filter("lines", lambda _, i: F.get("stays", F.get("at", i)))
    return texts.select("page_id", "url", F.array_join(lines, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
