"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path and cut into pieces at exact ranks, so a host of any size spreads over many
tasks; the pages next to a cut go to both sides. Each page is paired with that neighbour in its host whose path shares more
with its own; their text lines are aligned by longest common subsequence. Shared lines are template, not text: outside an
article element, in its blocks of doubtful markup, and at its beginning and end if all pages around it have them there.
Markup settles what differencing can't: elements that are never text (menus, forms, scripts, ...) go even if they differ,
and the inner lines of an article stay even if shared, as versions of an article share them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, piece_of, placed, ranked, read, share_code, splitters

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^>]*(?:>|\Z))", re.S)
_RAW = {"script", "style", "template", "textarea", "title", "iframe"}
_DROP = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_MAIN = {"article", "main"}
#: Elements of other markup languages: in these alone a slash at a tag's end closes the element.
_FOREIGN = {"svg", "math"}
#: Class, id, role or itemprop of other elements that usually hold the article, perhaps with some template around it.
_LIKELY = re.compile(r"(?:^|[\s_-])(?:main|content|article|articlebody|post|entry|story)(?:$|[\s_-])", re.I)
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: An article element is only ever one of these among others.
_NOISY_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|reply|replies|related|teaser|widget)(?:$|[\s_-])", re.I)
#: Words of class, id or role that mark what is not the article, and those that don't always: within an article element
#: differencing decides their blocks.
_SURE = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|side-bar|comments?|disqus|replies|nav|navbar|navigation|navi|menu|breadcrumbs?|footer|header|masthead|topbar|contentinfo"
_UNSURE = r"respond|share|sharing|social|related|widget|toolbar|pagination|pager|search|complementary"
_word = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)
_NOISE, _NOISE_IN_ARTICLE, _DOUBTFUL = _word(f"{_SURE}|{_UNSURE}"), _word(_SURE), _word(_UNSURE)
#: Above the first share of a page's own characters, its partner may be a copy: only lines that a second page has too are
#: template. Where there is none, or both have more than the second share, what they share says nothing.
COPY, COPIES = 0.5, 0.9
#: Where differencing can't tell, likely elements are the article if they hold this share of a page's own characters.
ENOUGH = 1 / 3
#: Pages of a piece, about, and how many pieces there are at least and at most; pages of a piece of a small table. Pieces
#: of a task, where there are more than the least number.
PIECE_ROWS, PIECES, LEAST_ROWS, TASK_PIECES = 2_000, (64, 50_000), 32, 16
#: Pages before and after a cut that go to both sides: as many as a page is compared with.
AROUND = 3
#: An article's first or last lines are template if so many of these pages, and all that there are, have them there.
WITNESSES = 3
#: Bits of a table that shared() keeps at most; larger ones are cut in two.
TABLE_BITS = 1 << 28
_SPACE = re.compile(r"\s+")
_CLOSE = re.compile(r"</([A-Za-z][A-Za-z0-9:-]*)\s*>")

MAIN, LIKELY, OTHER, NOISE, DOUBT = range(5)


def _noisy(name: str, attributes: str, inside: bool) -> bool:
    if name in _DROP:
        return True
    if name in ("html", "body") or not attributes.strip():
        return False
    words = _NOISY_ARTICLE if name in _MAIN else _NOISE_IN_ARTICLE if inside else _NOISE
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role") and words.search(value):
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


def _doubtful(name: str, attributes: str) -> bool:
    return name not in _MAIN and bool(attributes.strip()) and any(key.lower() in ("class", "id", "role") and _DOUBTFUL.search("".join(values)) for key, *values in _ATTRIBUTE.findall(attributes))


def _likely(name: str, attributes: str) -> bool:
    if name in ("html", "body") or not attributes.strip():
        return False
    return any(key.lower() in ("class", "id", "role", "itemprop") and _LIKELY.search("".join(values)) for key, *values in _ATTRIBUTE.findall(attributes))


def lines(page: str | None) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with MAIN (in an article or main element), DOUBT (there, in a block of
    doubtful markup), LIKELY (in an element named like an article), OTHER or NOISE.

    Character references are decoded, white space is one space. An element that never closes ends with its parent or the
    page; markup that breaks off is dropped. Linear in the page."""
    text, out, buffer = page or "", [], []
    noise: list[str] = []  # open elements from the first noisy one on
    depth = {"article": 0, "main": 0}
    foreign = 0
    doubt: list[str] = []  # open elements of the doubtful element's own name, itself first
    likely: list[str] = []  # the same of the likely element
    closes = {m[1].lower(): m.start() for m in _CLOSE.finditer(text)}  # where each name closes for the last time
    at = 0

    def kind() -> int:
        if noise:
            return NOISE
        return (DOUBT if doubt else MAIN) if any(depth.values()) else LIKELY if likely else OTHER

    def flush() -> None:
        s = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if s:
            out.append((s, kind()))

    while True:
        m = _TOKEN.search(text, at)
        buffer.append(text[at : m.start() if m else len(text)])
        if not m:
            break
        at = m.end()
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        inside = any(depth.values())
        noisy = not closing and _noisy(name, attributes, inside)
        unsure = inside and not closing and (name == doubt[0] if doubt else _doubtful(name, attributes))
        ends = bool(closing and doubt and name == doubt[0])
        if name in _INLINE and not (noise or noisy or unsure or ends):
            if name in ("br", "img", "wbr"):
                buffer.append(" ")
            continue
        if name not in _INLINE or not noise:
            flush()
        if not closing and name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        alone = bool(foreign) and attributes.rstrip().endswith("/")
        if name in _FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (not attributes.rstrip().endswith("/"))
        if name in _VOID or (alone and not closing):
            continue
        if noise and not closing and (noise[0] == "p" or noise[0] == name == "li") and name not in _INLINE:
            noise.clear()  # a paragraph ends where a block begins, an item where the next does
        if closing:
            if noise:
                if name in noise:
                    while noise and noise.pop() != name:
                        pass
                elif name in _MAIN and depth[name]:  # an article that ends closes what is open in it
                    noise.clear()
                    doubt.clear()
                    depth[name] -= 1
            elif name in _MAIN and depth[name]:
                doubt.clear()
                depth[name] -= 1
            elif ends:
                doubt.pop()
            elif likely and name == likely[0]:
                likely.pop()
        elif noise or noisy:
            # An unclosed element must not swallow the article that follows it.
            if noise and name in _MAIN and not noisy and closes.get(noise[0], -1) < at:
                noise.clear()
                depth[name] += 1
            elif name not in ("p", "li") or not noise:
                noise.append(name)
        elif name in _MAIN:
            depth[name] += 1
        elif unsure:
            doubt.append(name)
        elif name == likely[0] if likely else _likely(name, attributes):
            likely.append(name)
    flush()
    return out


def _rows(a: list, b: list):
    """Bit vectors over b's positions, before a's first element and after each: a bit is 0 where the length of the longest
    common subsequence grows."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    masks = {}
    for x, at in where.items():
        bits = bytearray(len(b) // 8 + 1)
        for j in at:
            bits[j >> 3] |= 1 << (j & 7)
        masks[x] = int.from_bytes(bits, "little")
    mask = (1 << len(b)) - 1
    v = mask
    yield v
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & mask
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequence of `a` and every beginning of `b`."""
    for last in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list, b: list) -> set[int]:
    """Positions of `a` in a longest common subsequence of `a` and `b`.

    Equal beginnings and ends are set aside first. Tables of more than TABLE_BITS are never kept: the halves of `a` meet
    different parts of `b`, found from the last rows of two tables, so memory is linear in the lines."""
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, n, lead, m = todo.pop()
        while lo < n and lead < m and a[lo] == b[lead]:
            out.add(lo)
            lo, lead = lo + 1, lead + 1
        while n > lo and m > lead and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.add(n)
        if lo == n or lead == m:
            continue
        x, y = a[lo:n], b[lead:m]
        if len(x) > 1 and len(x) * len(y) > TABLE_BITS:
            half = len(x) // 2
            cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
            todo += [(lo, lo + half, lead, lead + cut), (lo + half, n, lead + cut, m)]
            continue
        rows = list(_rows(x, y))
        i, j = len(x), len(y)
        length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()  # noqa: E731, B023
        here = length(i, j)
        while i and j and here:
            if length(i - 1, j) == here:
                i -= 1
            elif length(i, j - 1) == here:
                j -= 1
            else:
                i, j, here = i - 1, j - 1, here - 1
                out.add(lo + i)
    return out


@dataclass
class Page:
    row: tuple  # page_id, url
    group: str  # host
    path: str
    lines: list[tuple[str, int]]
    own: bool = True  # else only its neighbours' text is wanted here

    def texts(self) -> list[str]:
        return [t for t, _ in self.lines]

    def article(self) -> list[str]:
        return [t for t, k in self.lines if k == MAIN]


def common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def nearest(page: Page, before: Page | None, after: Page | None) -> Page | None:
    """The neighbour of the same group whose path is nearest; another path before an equal one, the later of equals."""
    near = [p for p in (after, before) if p is not None and p.group == page.group]
    return max(near, key=lambda p: (p.path != page.path, common(p.path, page.path)), default=None)


def _edges(page: Page, near: list[Page]) -> tuple[int, int]:
    """How many lines at the beginning and at the end of the page's article are template: those that at least WITNESSES pages
    around it have, none lacks and none is a copy that would (sharing over COPY of the article, by characters); if a line
    of its own is left."""
    mine, size = page.article(), sum(map(len, page.article()))
    ends = []
    for p in near if len(near) >= WITNESSES else ():
        theirs = p.article()
        run = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        ends.append((run(mine, theirs), run(mine[::-1], theirs[::-1])))
        if not any(map(min, zip(*ends, strict=True))) or sum(len(mine[i]) for i in shared(mine, theirs)) > COPY * size:
            return 0, 0
    first, last = (min(x) for x in zip(*ends, strict=True)) if ends else (0, 0)
    return (first, last) if first + last < len(mine) else (0, 0)


def main_text(page: Page, partner: Page | None, others: list[Page] = ()) -> tuple[str, int, int]:
    """The page's text, how many of its lines its partner shares, and how many lines differencing took that markup alone
    would have kept; `others` are the next pages of its group, by place, that are not the partner."""
    texts, other = page.texts(), others[0] if others else None
    same = shared(texts, partner.texts()) if partner else set()
    own = [i for i, (_, k) in enumerate(page.lines) if k not in (NOISE, DOUBT)]
    size = lambda found: sum(len(texts[i]) for i in found)
    share = lambda found: size(i for i in own if i in found)
    main, likely = ([i for i in own if page.lines[i][1] == k] for k in (MAIN, LIKELY))
    template, most = same, COPY
    if other and share(same) > COPY * size(own):  # a copy, or a short text in a long template: the other page tells
        template, most = same & shared(texts, other.texts()), COPIES
    apart = bool(partner) and share(template) <= most * size(own)  # differencing can tell template from text
    rest = [i for i in own if i not in main]
    took = 0
    if apart:
        took = sum(i in template for i in rest)
        rest = [i for i in rest if i not in template]
    elif size(main) >= ENOUGH * size(own):
        rest = []
    elif not main and size(likely) >= ENOUGH * size(own):
        rest = likely
    if main and apart:
        first, last = _edges(page, [partner, *others])
        took += first + last
        main = main[first : len(main) - last]
    doubtful = [i for i, (_, k) in enumerate(page.lines) if k == DOUBT and apart and i not in template]
    return "\n\n".join(texts[i] for i in sorted([*main, *rest, *doubtful])), len(same), took


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, piece, host, path, own) in order; each is held until the next AROUND of its piece have come."""
    past, ahead, rows, held, now = [], [], [], 0, None

    def out() -> pa.RecordBatch:
        names = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64()), ("n_decided", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])

    def done() -> None:
        nonlocal past, held
        page = ahead.pop(0)
        if page.own:
            before, after = past[-1] if past else None, ahead[0] if ahead else None
            partner = nearest(page, before, after)
            others = [p for p in [before, after, *past[-2::-1], *ahead[1:]] if p is not None and p is not partner and p.group == page.group]
            text, *n = main_text(page, partner, others)
            rows.append((*page.row, text, len(text), *n))
            held += len(text)
        past = [*past, page][-AROUND:]

    for b in batches:
        for page_id, url, page, piece, host, path, own in zip(*b.columns, strict=True):
            if (p := piece.as_py()) != now:
                while ahead:
                    done()
                past, now = [], p
            ahead.append(Page((page_id.as_py(), url.as_py()), host.as_py(), path.as_py(), lines(page.as_py()), own.as_py()))
            if len(ahead) > AROUND:
                done()
            if held > 4 << 20:
                yield out()
                rows, held = [], 0
    while ahead:
        done()
    if rows:
        yield out()


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text; blocks joined by two line breaks, empty if none), n_chars, n_shared (lines
    that the paired page shares) and n_decided (lines that differencing took and markup had left) of every row of `pages` (page_id,
    url, html).

    A null html is empty; a page of any length is taken whole, in memory linear in its lines. Null urls, and urls without a
    scheme, share one empty host. Repeated rows stay repeated, and are copies of one another; an empty table gives none;
    other columns are left out. The result depends on the rows alone: a page's neighbours are those in the order of host,
    path, id and a hash, whatever piece they are in."""
    share_code(spark)
    rows = placed(spark, pages.select("page_id", "url", "html"))
    url = F.coalesce(F.col("row.url"), F.lit(""))
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host, path = F.lower(F.regexp_extract(url, scheme + r"([^/?#]*)", 1)), F.rtrim(F.regexp_extract(url, scheme + r"[^/?#]*([^?#]*)", 1), F.lit("/"))
    id_ = F.coalesce(F.col("row.page_id").cast("long"), F.lit(-(2**63)))
    keys, types = ["host", "path", "id_", "hash"], ["string", "string", "long", "long"]
    ordered = [host.alias("host"), path.alias("path"), id_.alias("id_"), F.xxhash64("row.html", "place").alias("hash")]
    places = ranked(spark, rows.select(*ordered), keys)
    n = places.count()
    pieces = min(PIECES[1], max(min(PIECES[0], n // LEAST_ROWS), n // PIECE_ROWS))
    # The piece of a page, and of those that it is next to: cuts a little before and a little behind tell.
    of = lambda shift: piece_of([F.col(k) for k in keys], types, splitters(places, keys, n, pieces, shift=shift))
    rows = rows.select(F.col("row.page_id").cast("long").alias("page_id"), F.col("row.url").alias("url"), F.col("row.html").alias("html"), *ordered)
    rows = rows.withColumns({"at": of(0), "near": F.array(of(-AROUND), of(AROUND))})
    rows = rows.withColumn("piece", F.explode(F.array_distinct(F.concat(F.array("at"), "near"))))
    tasks = max(1, min(pieces, max(PIECES[0], pieces // TASK_PIECES)))
    rows = rows.repartitionById(tasks, (F.col("piece") % tasks).cast("int")).sortWithinPartitions("piece", *keys)
    rows = rows.select("page_id", "url", "html", "piece", "host", "path", (F.col("piece") == F.col("at")).alias("own"))
    return rows.mapInArrow(lean(_extracted), "page_id long, url string, text string, n_chars long, n_shared long, n_decided long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the main text of every page."""
    return extract(spark, read(spark, sf_dir, "pages").select("page_id", "url", "html"))
