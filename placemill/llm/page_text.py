"""HTML extraction by nearest-URL page differencing.

Pages are sorted by host and URL path; each is compared with the neighbour of its host whose path shares the longer start.  Their lines
(blocks of text) are aligned by a longest common subsequence, and shared lines are deleted.  A pair that shares most of both pages' text is a pair of copies
and tells nothing, so neighbours that are copies form a run, and a page is compared with the nearest pages outside its run and with the
ends of the run, the likest path first, until one is no copy.

All pages of all hosts are differenced.  The markup is the check that follows.  Lines that it marks as menus, headers, footers, sidebars, notices, adverts,
forms or comments are deleted too, since neighbours need not share them.  Where an article or main element claims lines, it takes back those that were deleted
as shared (copies of an article and sentences that articles share would go otherwise), and the lines outside it go.

All lines are read whole by one linear pass over the page, and pages of very many lines are aligned in bounded memory.

Null and empty html give empty text.  A null url belongs to no host, so its page is compared with none; a page
without an id is compared like any other.  Repeated rows get the same text.
Nothing is cut off or capped; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import cut, mapped, table, tidy

#: Above this share of both pages' characters two neighbours are copies; of the shorter page alone, it may be a template's share.
COPY_SHARE = 0.6
#: Pairs of lines of two pages whose alignment is held whole (a bit each).
CELLS = 100_000_000

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "audio", "video", "select", "xmp", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
INLINE |= {"object", "math", "maction", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
#: Elements that hold a part of a page; inside an article, only theirs are the NAMES that count.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "fieldset", "center", "header"}
SPACE = {"br", "td", "th"}
AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|footer|masthead"
    r"|cookie|cookies|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|comment|comments|disqus|reply|replies)(?:$|[\s_-])",
    re.IGNORECASE,
)

_OPEN = re.compile(r"</?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"['\">]")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")

Block = tuple[str, bool, bool]


def _is_away(name: str, attributes: str, in_article: bool) -> bool:
    if name in AWAY or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    for key, a, b, c, hidden in _ATTR.findall(attributes):
        key, value = key.lower(), a or b or c
        if hidden or key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and (name in CONTAINERS or not in_article) and NAMES.search(value):
            return True
        if key in ("class", "id") and name == "article" and re.search(r"comment|repl(?:y|ies)", value, re.IGNORECASE):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text, name of a start or end tag with its slash, attributes, where the tag ends): text before each tag; the last one has no tag.

    Each character is looked at a bounded number of times.  A tag ends at the first > outside quotes; where a quote or a tag isn't closed, at the
    first > at all; a < that begins no tag is text, and a tag that the page's end cuts off is none.  Send a place to go on from there.
    """
    n, at, begun = len(page), 0, 0
    last = {c: page.rfind(c) for c in "<>'\""}
    plain = 0  # up to here quotes mean nothing

    def end_of(i: int) -> int:
        nonlocal plain
        if i > last[">"]:
            return -1
        j = i
        while i >= plain:
            found = _STOP.search(page, j)
            if found is None:
                plain = n
            elif found[0] == ">":
                return found.start()
            elif found.end() > last[found[0]]:
                plain = found.end()
            else:
                j = page.index(found[0], found.end()) + 1
        return page.find(">", i)

    while (at := page.find("<", at)) >= 0:
        name, attributes = "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            to = n if end < 0 else end + 3
        elif at > last[">"] and at != last["<"] and page[at + 1] not in "!?/":  # nothing closes here any more
            at += 1
            continue
        elif found := _OPEN.match(page, at):
            end = end_of(found.end())
            if end < 0 and at != last["<"]:
                at += 1
                continue
            name, attributes, to = ("", "", n) if end < 0 else (found[0][1:].lower(), page[found.end() : end], end + 1)
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at + 2) if at + 2 <= last[">"] else -1
            to = n if end < 0 else end + 1
        else:
            at += 1
            continue
        jump = yield page[begun:at], name, attributes, to
        at = begun = to if jump is None else jump
    yield page[begun:], "", "", n


def blocks(page: str | None) -> list[Block]:
    """(text, an article or main element has it, markup marks it as no text of the page) of each block with text, in order."""
    out: list[Block] = []
    if not page:
        return out
    parts: list[str] = []
    opened: list[tuple[str, bool, bool]] = []  # name, claims, away
    depth: dict[str, int] = {}  # open elements of a name
    claims = aways = 0  # open elements that claim or are away

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, claims > 0, aways > 0))
            parts.clear()

    def push(name: str, away: bool) -> None:
        nonlocal claims, aways
        claim = name in ("article", "main")
        opened.append((name, claim, away))
        depth[name] = depth.get(name, 0) + 1
        claims += claim
        aways += away

    def pop() -> None:
        nonlocal claims, aways
        name, claim, away = opened.pop()
        depth[name] -= 1
        claims -= claim
        aways -= away

    source = tokens(page)
    jump = None
    while True:
        try:
            text, tag, attributes, to = source.send(jump)
        except StopIteration:
            break
        jump = None
        if text:
            parts.append(html.unescape(text))
        if not tag:  # a comment, a declaration or the end
            continue
        ends, name = tag[0] == "/", tag.removeprefix("/")
        if name in RAW and not ends:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, to)
                jump = end.end() if end else len(page)
            continue
        if name in SPACE:
            parts.append(" ")
        if name in INLINE or name in SPACE:
            if name in VOID or name not in ("span", "a", "label", "small"):
                continue
        else:
            close()
        if name in VOID:
            continue
        if ends:
            if depth.get(name):
                k = len(opened) - 1
                while opened[k][0] != name:
                    k -= 1
                if any(a for _, _, a in opened[k:]):
                    close()
                while len(opened) > k:
                    pop()
        else:
            away = _is_away(name, attributes, claims > 0)
            if name in ("p", "li", "option", "tr") and opened and opened[-1][0] == name:
                pop()
            if away and name in INLINE:
                close()
            if away or name not in INLINE and name != "p" or name in ("span", "a", "label", "small"):
                push(name, away)
    close()
    return out


def line_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _longest(mine: list[int], other: list[int]) -> list[int]:
    """Places in mine of a longest common subsequence, by bit-parallel rows that are all kept."""
    there: dict[int, int] = {}
    for k, x in enumerate(other):
        there[x] = there.get(x, 0) | 1 << k
    if not there or not any(x in there for x in mine):
        return []
    full = (1 << len(other)) - 1
    rows, v = [], full
    for x in mine:
        rows.append(v)
        u = v & there.get(x, 0)
        v = ((v + u) | (v - u)) & full
    rows.append(v)
    # back from the end: a zero bit k of row i says that other[:k + 1] is one longer a match than other[:k]
    out, k = [], len(other)
    for i in range(len(mine), 0, -1):
        zeros = ~rows[i] & ((1 << k) - 1)
        if not zeros:
            break
        before = ~rows[i - 1] & ((1 << k) - 1)
        if zeros.bit_count() > before.bit_count():  # line i - 1 makes the match longer
            out.append(i - 1)
            hits = there[mine[i - 1]] & ((1 << k) - 1)
            # the last place that matches and leaves the rest of the match before it
            want = before.bit_count()
            while True:
                k = hits.bit_length() - 1
                if (~rows[i - 1] & ((1 << k) - 1)).bit_count() == want:
                    break
                hits &= ~(1 << k)
    return out[::-1]


def _prefix_lengths(mine: list[int], other: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of mine with each start of other."""
    there: dict[int, int] = {}
    for k, x in enumerate(other):
        there[x] = there.get(x, 0) | 1 << k
    full = v = (1 << len(other)) - 1
    for x in mine:
        u = v & there.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((~v & full).to_bytes(len(other) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(other)]
    return np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))


def shared_lines(mine: list[int], other: list[int], cells: int = CELLS) -> list[int]:
    """Places in mine of a longest common subsequence; pages of more than `cells` pairs of lines are split in halves (Hirschberg), so memory is bounded."""
    n = min(len(mine), len(other))
    head = next((k for k in range(n) if mine[k] != other[k]), n)
    tail = next((k for k in range(n - head) if mine[-1 - k] != other[-1 - k]), n - head)
    inner, rest = mine[head : len(mine) - tail], other[head : len(other) - tail]
    if len(inner) * len(rest) <= cells or len(inner) < 2:
        found = _longest(inner, rest)
    else:
        half = len(inner) // 2
        total = _prefix_lengths(inner[:half], rest) + _prefix_lengths(inner[:half - 1 : -1], rest[::-1])[::-1]
        cut_at = int(np.argmax(total))
        found = shared_lines(inner[:half], rest[:cut_at], cells) + [half + k for k in shared_lines(inner[half:], rest[cut_at:], cells)]
    return [*range(head), *[head + k for k in found], *range(len(mine) - tail, len(mine))]


LINES = "page_id long, key long, url string, lines array<long>, chars array<int>"
TEXTS = "page_id long, key long, url string, text string, marks binary"
OUT = "page_id long, url string, text string, n_shared long, n_taken_back long"
PAGE = "struct<host:string,path:string,page_id:long,key:long,lines:array<long>,chars:array<int>>"
EDGES = f"part int, runs long, head {PAGE}, head_end {PAGE}, second {PAGE}, tail {PAGE}, tail_begin {PAGE}, before_tail {PAGE}"

_PAGE = [("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("key", pa.int64()), ("lines", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32()))]
_EDGES = pa.schema([("part", pa.int32()), ("runs", pa.int64()), *[(c, pa.struct(_PAGE)) for c in ("head", "head_end", "second", "tail", "tail_begin", "before_tail")]])
_ONWARD = pa.schema([*_PAGE, ("part", pa.int32()), ("place", pa.int64()), ("begins", pa.bool_()), ("like", pa.int64()), ("number", pa.int32()), ("shared", pa.list_(pa.int32()))])
_SHARED = pa.schema([("page_id", pa.int64()), ("key", pa.int64()), ("shared", pa.list_(pa.int32()))])


def line_keys(pages: DataFrame) -> DataFrame:
    """LINES of pages (page_id, key, url, html): keys and lengths of all lines."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t for t, _, _ in blocks(x.as_py())] for x in batch.column(3)]
            lines, chars = [[line_key(t) for t in f] for f in found], [[len(t) for t in f] for f in found]
            columns = [*batch.columns[:3], pa.array(lines, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "key", "url", "lines", "chars"])

    return mapped(pages.select("page_id", "key", "url", "html"), emit, LINES)


def line_texts(pages: DataFrame) -> DataFrame:
    """TEXTS of pages (page_id, key, url, html): all lines, joined, and a byte for each: 1 where an article or main element has it, 2 where it is away, 3 for both."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(x.as_py()) for x in batch.column(3)]
            texts, marks = ["\n".join(t for t, _, _ in f) for f in found], [bytes(claimed | away << 1 for _, claimed, away in f) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(marks, pa.binary())], ["page_id", "key", "url", "text", "marks"])

    return mapped(pages.select("page_id", "key", "url", "html"), emit, TEXTS)


def _copies(mine: dict, other: dict, shared: list[int]) -> bool:
    return sum(mine["chars"][k] for k in shared) > COPY_SHARE * max(1, sum(mine["chars"]), sum(other["chars"]))


def _page(row: dict) -> dict:
    return {c: row[c] for c, _ in _PAGE}


def _begins(page: dict, before: dict | None) -> bool:
    """Whether a page begins a run of copies, after the page before it in the order."""
    return before is None or before["host"] != page["host"] or not _copies(page, before, shared_lines(page["lines"], before["lines"]))


def likest(page: dict, near: list[tuple[int, dict | None]], best: tuple[int, int, list[int]] | None = None) -> tuple[int, int, list[int]] | None:
    """(less the characters that the paths begin with alike, number, shared lines) of the first of near (number, page) that is no copy, unless best comes before it."""

    def alike(a: str, b: str) -> int:
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    others = [(-alike(o["path"], page["path"]), k, o) for k, o in near if o and o["host"] == page["host"] and (o["page_id"], o["key"]) != (page["page_id"], page["key"])]
    for like, k, o in sorted(others, key=lambda x: x[:2]):
        if best and best[:2] < (like, k):
            break
        found = shared_lines(page["lines"], o["lines"])
        if not _copies(page, o, found):
            return like, k, found
    return best


class Onward:
    """What is known of a page from those before it: the first page of its run, and the last one of the run before."""

    def __init__(self, last: dict | None = None, first: dict | None = None, before: dict | None = None):
        self.last, self.first, self.before = last, first, before

    def step(self, page: dict) -> bool:
        if begins := _begins(page, self.last):
            self.first, self.before = page, self.last
        self.last = page
        return begins


class Backward:
    """What is known of a page from those behind it: the last page of its run, and the first one of the run behind."""

    def __init__(self, next_: dict | None = None, begins: bool = True, last: dict | None = None, after: dict | None = None):
        self.next, self.begins, self.last, self.after = next_, begins, last, after

    def step(self, page: dict, begins: bool) -> None:
        if self.begins:
            self.last, self.after = page, self.next
        self.next, self.begins = page, begins


def edges(placed: DataFrame) -> DataFrame:
    """EDGES of each part of placed: its first and last pages, and where its first and last runs end and begin."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = Onward(), {"runs": 0}
        for batch in batches:
            for row in batch.to_pylist():
                page, end = _page(row), at.last
                if at.step(page):
                    out["runs"] += 1
                    if out["runs"] == 1:
                        out |= {"part": row["part"], "head": page}
                    elif out["runs"] == 2:
                        out |= {"head_end": end, "second": page}
        if out["runs"]:
            yield pa.RecordBatch.from_pylist([{"head_end": at.last} | out | {"tail": at.last, "tail_begin": at.first, "before_tail": at.before}], _EDGES)

    return mapped(placed, emit, EDGES)


def across(parts: list[dict]) -> dict[int, tuple[Onward, Backward]]:
    """What is known on either side of each part, from the EDGES of all in order: runs may go on over any number of them."""
    onward, backward, begun = {}, {}, {}
    at = Onward()
    for e in parts:
        onward[e["part"]], begun[e["part"]] = at, _begins(e["head"], at.last)
        if e["runs"] > 1:
            at = Onward(e["tail"], e["tail_begin"], e["before_tail"])
        else:
            at = Onward(e["tail"], e["head"], at.last) if begun[e["part"]] else Onward(e["tail"], at.first, at.before)
    back = Backward()
    for e in reversed(parts):
        backward[e["part"]] = back
        if e["runs"] > 1:
            last, after = e["head_end"], e["second"]
        else:
            last, after = (e["tail"], back.next) if back.begins else (back.last, back.after)
        back = Backward(e["head"], begun[e["part"]], last, after)
    return {p: (onward[p], backward[p]) for p in onward}


def differences(lines: DataFrame) -> DataFrame:
    """(page_id, key, shared) for the pages that share lines with their nearest neighbour of the host, from `line_keys`.

    The pages are sorted over ranges once.  A pass along each range and one back meet a page's neighbours on either side and hold a few pages; of each
    range, only its edges (six pages) are gathered, to go on from in the next one.
    """
    spark = lines.sparkSession
    site, order = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", [F.col(c) for c in ("host", "path", "page_id", "key")]
    sited = lines.withColumns({"host": F.lower(F.regexp_extract("url", site, 1)), "path": F.regexp_extract("url", site, 2)}).filter("host <> ''")
    ranges = sited.select(*[c for c, _ in _PAGE]).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = cut(ranges.withColumn("part", F.spark_partition_id()))  # its rows keep their parts and their order
    sides = spark.sparkContext.broadcast(across([r.asDict(recursive=True) for r in sorted(edges(placed).collect(), key=lambda r: r["part"])]))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = at or copy.copy(sides.value[row["part"]][0])
                page, place = _page(row), place + 1
                begins = at.step(page)
                like, number, shared = likest(page, [(0, at.before), (2, at.first)]) or (None, None, None)
                out.append(row | {"place": place, "begins": begins, "like": like, "number": number, "shared": shared})
            yield pa.RecordBatch.from_pylist(out, _ONWARD)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = at or copy.copy(sides.value[row["part"]][1])
                page = _page(row)
                at.step(page, row["begins"])
                found = likest(page, [(1, at.after), (3, at.last)], None if row["shared"] is None else (row["like"], row["number"], row["shared"]))
                if found and found[2]:
                    out.append({"page_id": row["page_id"], "key": row["key"], "shared": found[2]})
            yield pa.RecordBatch.from_pylist(out, _SHARED)

    onward = mapped(placed, along, ", ".join([*[f"{c} {k}" for c, k in placed.dtypes], "place long, begins boolean, like long, number int, shared array<int>"]))
    out = mapped(onward.sortWithinPartitions(F.desc("place")), back, "page_id long, key long, shared array<int>")
    return cut(out.dropDuplicates(["page_id", "key"]))


def left_lines(found: list[Block], shared: list[int] | None) -> tuple[list[int], int]:
    """Places of the lines that stay, and how many shared ones an article took back."""
    gone = set(shared or ())
    left = [k for k in range(len(found)) if k not in gone]
    # the check by markup: an article takes back its own lines, and what is away or outside of it goes
    back = [k for k in gone if found[k][1] and not found[k][2]]
    article = any(claimed and not away for _, claimed, away in found)
    return sorted(k for k in left + back if not found[k][2] and (found[k][1] or not article)), len(back)


def main_text(found: list[Block], shared: list[int] | None) -> str:
    return "\n".join(found[k][0] for k in left_lines(found, shared)[0])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_taken_back), a row for each row of pages (page_id, url, html).

    n_shared: lines that differencing deletes; n_taken_back: those of them that the page's article takes back.  Pages are parsed twice, for the
    narrow keys of the lines that are sorted and compared, and for the texts, so that no copy of these is held meanwhile.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("key", F.xxhash64("url", "html"))
    apart = differences(cut(line_keys(rows))).select(F.col("page_id").alias("id"), F.col("key").alias("at"), "shared")
    tidy(rows.sparkSession)
    joined = line_texts(rows).join(apart, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("at")), "left")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_shared, n_back = [], [], []
            for text, marks, shared in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                lines = text.split("\n")
                left, back = left_lines([(t, m & 1 > 0, m & 2 > 0) for t, m in zip(lines, marks, strict=bool(marks))], shared)
                texts.append("\n".join(lines[k] for k in left))
                n_shared.append(len(shared or ()))
                n_back.append(back)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n_shared, pa.int64()), pa.array(n_back, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_shared", "n_taken_back"])

    out = mapped(joined.select("page_id", "url", "text", "marks", "shared"), emit, OUT)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_taken_back")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


SQL = None
