"""Main text of pages by nearest-URL differencing.

A page is read into text lines, one a block, each with where it stands: in the page's declared
article, in a landmark (menu, footer, advert, form, ...), or elsewhere.  Pages of a host are ordered
by URL path; each is aligned with its nearest neighbour by a longest common subsequence of lines, and
lines that both share belong to the site, so they go.  Lines of the declared article are shared only
in the same slot (tags and classes from the top of the page), and go only if the site at large has
them there: on ``SITE_PAGES`` different pages of the host at least, and on ``SITE_SHARE`` of them.
A landmark's lines count as shared by the kind of landmark, as sites fill them anew for each page; all
others by their text.  Landmark lines without a counterpart go as well; all other lines stay.  A page
whose host has no different one has nothing to be compared with: its text is the declared article if
it has one, else all but its landmarks.  Mirrors, pages of a host with equal text outside landmarks,
are one page, at the smallest of their paths.

The pages' lines outside landmarks move once, to meet their decisions; what is sorted and aligned is a
hash a line.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, written
from .urls import url_parts

ARTICLE, MAIN, BODY, LANDMARK = 3, 2, 1, 0

# Elements that never hold main text, and those whose content is no markup.
LANDMARK_TAGS = frozenset("nav header footer aside form button select datalist textarea dialog menu noscript iframe object svg template head title canvas".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start of these ends an open paragraph.
PARAGRAPH_ENDS = BLOCK_TAGS - frozenset("body head html title legend option tbody td tfoot th thead tr".split())
# An unclosed element of these ends where the next of its group starts, unless an element of WALLS stands between.
OPEN_ENDED = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4}
WALLS = {
    "ul": (1,), "ol": (1,), "menu": (1,), "dl": (2,), "button": (0,), "object": (0, 1, 2), "template": (0, 1, 2), "caption": (0, 1, 2),
    "tr": (3,), "td": (0, 1, 2), "th": (0, 1, 2), "table": (0, 1, 2, 3, 4),
}
CELLS = frozenset("table td th caption object template".split())
TABLE_PARTS = frozenset("html body table tbody thead tfoot".split())
# Their end tags reach across blocks, as those of blocks do.
REACHING = BLOCK_TAGS | LANDMARK_TAGS | frozenset("a b big code em font i nobr s small strike strong tt u".split())
LANDMARK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words in class and id attributes; a hyphen, an underscore or another mark ends a word.
LANDMARK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert sidebar comment comments commentlist disqus respond replies nav navbar navigation menu breadcrumb breadcrumbs footer header "
    "masthead popup modal overlay newsletter subscribe signup login share sharing social related recommended pagination pager widget toolbar skip".split()
)
# Of them, those that also name parts of an article; there they count as a whole name, or with a word of the page's furniture.
ARTICLE_PARTS = frozenset("header footer related notice alert banner overlay navigation menu respond skip social consent".split())
FURNITURE = frozenset("articles bar box content links list news posts site stories widget".split())
ARTICLE_WORDS = frozenset(("article-body", "articlebody", "article-content", "entry-content", "post-content", "post-body", "story-body"))

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
# Attributes up to the end of the tag; a quote within an unquoted value is part of it.
ATTRIBUTES = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+>""")
RAW_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW_TAGS}
LONG_REFERENCE = re.compile(r"&#([0-9]{20,});?")
# A shared line of a declared article is the site's if so many different pages of the host have it in that slot, and so large a share of them.
SITE_PAGES, SITE_SHARE = 3, 0.5
# The lines of the site meet the pages in so many parts, as a large host may have one on each of its pages.
PARTS = 16


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if "=" in text or "hidden" in text.lower():
        for m in ATTRIBUTE.finditer(text):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _kind(tag: str, found: dict[str, str], inside: bool) -> int | None:
    """Where an element puts its lines, if it changes that; ``inside`` an article fewer names tell."""
    if tag in LANDMARK_TAGS or found.get("role", "").lower() in LANDMARK_ROLES:
        return LANDMARK
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    if tag not in ("html", "body", "article", "main"):
        for name in names:
            parts = set(re.split(r"[^a-z0-9]+", name))
            told = parts & LANDMARK_WORDS
            if inside and told <= ARTICLE_PARTS and (tag in HEADINGS or not (name in told or parts & FURNITURE)):
                continue
            if told:
                return LANDMARK
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return LANDMARK
    if tag == "article" or found.get("itemprop") == "articleBody" or ARTICLE_WORDS.intersection(names):
        return ARTICLE
    return MAIN if tag == "main" or found.get("role") == "main" else None


def _sign(found: dict[str, str]) -> str:
    """What names a landmark or a slot: its class, id and role without numbers."""
    return "" if not found else re.sub(r"\d+", "", " ".join(v for k, v in found.items() if k in ("class", "id", "role")))


def decoded(text: str) -> str:
    """Text with its character references decoded; numbers of any length are allowed."""
    if "&" not in text:
        return text
    # Eight digits are beyond the last character already.
    return entities.unescape(LONG_REFERENCE.sub(lambda m: f"&#{(m[1].lstrip('0') or '0')[:8]};", text))


class _Page:
    """Open elements and finished lines of a page that is being read.

    Words are kept with the place they were read at: those of a landmark within a block (a button, a
    marked span) become lines of their own, and the words around them stay one block.  Every step
    looks at the innermost elements only, so a page takes time linear in its length.
    """

    def __init__(self) -> None:
        self.lines: list[tuple[int, str, str]] = []
        # Tag, place, landmark and slot of what it holds, and where the innermost element of each open-ended group, cell and block is.
        self.stack: list[tuple[str, int, str, int, tuple[int, ...]]] = [("", BODY, "", 0, (0,) * 7)]
        self.open: dict[str, list[int]] = {}
        self.words: list[str] = []
        self.aside: list[str] = []
        self.asides: list[tuple[int, str, str]] = []
        self.place, self.slot, self.sign = BODY, 0, ""

    def text(self, text: str) -> None:
        _, place, landmark, slot, _ = self.stack[-1]
        if place == LANDMARK:
            if landmark != self.sign:
                self.end_aside()
                self.sign = landmark
            self.aside.append(text)
            return
        if text and not text.isspace():
            if not self.words:
                self.place, self.slot = place, slot
            self.place = max(self.place, place)
            self.words.append(text)
        elif text and self.words:
            self.words.append(" ")

    def end_aside(self) -> None:
        if text := " ".join("".join(self.aside).split()):
            self.asides.append((LANDMARK, self.sign, text))
        self.aside.clear()

    def end_line(self, whole: bool = True) -> None:
        """A block ends; within a landmark only that one's line does (not ``whole``)."""
        self.end_aside()
        if whole:
            if text := " ".join("".join(self.words).split()):
                self.lines.append((self.place, str(self.slot), text))
            self.words.clear()
        if not self.words:
            self.lines += self.asides
            self.asides.clear()

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop()[0]].pop()

    def start(self, name: str, found: dict[str, str]) -> None:
        scope = self.stack[-1][4]
        if name in PARAGRAPH_ENDS and scope[0]:
            self.cut(scope[0])
        group = OPEN_ENDED.get(name)
        if group and self.stack[-1][4][group]:
            self.cut(self.stack[-1][4][group])
        if name == "a" and self.open.get("a") and self.open["a"][-1] > self.stack[-1][4][6]:
            self.cut(self.open["a"][-1])
        _, place, landmark, slot, scope = self.stack[-1]
        block = name in BLOCK_TAGS
        if block:
            self.end_line(place != LANDMARK)
        elif name == "br":
            self.text(" ")
        if name in VOID_TAGS:
            return
        kind = None if place == LANDMARK else _kind(name, found, place > BODY)
        at = len(self.stack)
        if block or name in WALLS:
            ends = list(scope)
            for i in WALLS.get(name, ()):
                ends[i] = 0
            if group is not None:
                ends[group] = at
            if name in CELLS:
                ends[5] = at
            if block:
                ends[6] = at
                slot = xxhash.xxh3_64_intdigest(f"{slot} {name} {_sign(found)}".encode("utf-8", "surrogatepass"))
            scope = tuple(ends)
        if kind == LANDMARK:
            place, landmark = LANDMARK, f"{name} {_sign(found)}"
        elif kind is not None:
            place = max(kind, place)
        self.stack.append((name, place, landmark, slot, scope))
        self.open.setdefault(name, []).append(at)

    def end(self, name: str) -> None:
        before, scope = self.stack[-1][1], self.stack[-1][4]
        at = self.open[name][-1] if self.open.get(name) else 0
        if name in OPEN_ENDED:
            at = at if at == scope[OPEN_ENDED[name]] else 0
        elif name not in TABLE_PARTS and at < scope[5 if name in REACHING else 6]:
            at = 0
        if at:
            self.cut(at)
        if name in BLOCK_TAGS:
            self.end_line(LANDMARK not in (before, self.stack[-1][1]) or before != self.stack[-1][1])


def page_lines(html: str | None) -> list[tuple[int, str, str]]:
    """``(place, name, text)`` of every block with text, the name that of its landmark or slot; null is an empty page.

    References are decoded and white space is one space.  What a broken end of the page leaves open
    ends with the page; a tag without an end is text.  Where the quotes of a tag do not work out, they
    hide nothing in the rest of the page.
    """
    html = html or ""
    page = _Page()
    at, quotes = 0, True
    while at < len(html):
        mark = html.find("<", at)
        if mark < 0:
            mark = len(html)
        if mark > at:
            page.text(decoded(html[at:mark]))
        if mark >= len(html) - 1:
            page.text(html[mark:])
            break
        closing = html[mark + 1] == "/"
        name = NAME.match(html, mark + 1 + closing)
        if not name:
            if html.startswith("<!--", mark):
                end, size = html.find("-->", mark + 2), 3
            elif closing or html[mark + 1] in "!?":
                end, size = html.find(">", mark), 1
            else:
                page.text("<")
                at = mark + 1
                continue
            at = end + size if end >= 0 else len(html)
            continue
        end = ATTRIBUTES.match(html, name.end()) if quotes else None
        at = end.end() if end else html.find(">", name.end()) + 1
        quotes = end is not None
        if not at:
            page.text(decoded(html[mark:]))
            break
        tag = name[0].lower()
        if closing:
            page.end(tag)
            continue
        if tag == "body" and page.open.get("head"):
            page.cut(page.open["head"][-1])
        if tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                page.end_line(page.stack[-1][1] != LANDMARK)
            stop = RAW_ENDS[tag].search(html, at)
            stop = html.find(">", stop.end()) + 1 if stop else 0
            at = stop or len(html)
            continue
        page.start(tag, _attributes(html[name.end() : at - 1]))
    page.end_line()
    return page.lines


def line_kinds(lines: list[tuple[int, str, str]]) -> list[int]:
    """``ARTICLE`` for lines of the declared article, or without one of the declared main part; ``LANDMARK``; ``BODY`` for others."""
    best = max((place for place, _, _ in lines), default=BODY)
    return [ARTICLE if place == best > BODY else min(place, BODY) for place, _, _ in lines]


def line_keys(lines: list[tuple[int, str, str]]) -> np.ndarray:
    """A hash for each line: of the landmark, in the declared article of slot and text, else of the text."""
    named = zip(lines, line_kinds(lines), strict=True)
    keys = [f"<{name}>" if kind == LANDMARK else f"{name}\n{text}" if kind == ARTICLE else text for (_, name, text), kind in named]
    return np.array([xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys], np.uint64).view(np.int64)


def text_digest(lines: list[tuple[int, str, str]]) -> bytes:
    """A hash of all text outside landmarks and of what is declared an article; mirrors of a page have the same one."""
    named = zip(lines, line_kinds(lines), strict=True)
    text = "\n".join(f"{name if kind == ARTICLE else ''}\n{text}" for (_, name, text), kind in named if kind != LANDMARK)
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends are cut off and lines that the other has not are left out first.  The rest is computed
    row by row on bit vectors; large tables are halved, so memory stays linear.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner_a, inner_b = a[head : len(a) - tail], b[head : len(b) - tail]
    at = head + np.flatnonzero(np.isin(inner_a, inner_b))
    found = _subsequence(a[at].tolist(), inner_b[np.isin(inner_b, inner_a)].tolist())
    return [*range(head), *at[found].tolist(), *range(len(a) - tail, len(a))]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``a``: bit ``j`` is 0 where line ``j`` of ``b`` makes the subsequence longer."""
    masks: dict[int, int] = {}
    for j, key in enumerate(b):
        masks[key] = masks.get(key, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for key in a:
        hit = row & masks.get(key, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the common subsequence of ``a`` and each prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    grows = [row >> j & 1 == 0 for j in range(len(b))]
    return np.concatenate(([0], np.cumsum(grows)))


def _subsequence(a: list[int], b: list[int], most_bits: int = 1 << 28) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > most_bits and len(a) > 1:
        half = len(a) // 2
        fore, back = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(fore + back))
        return _subsequence(a[:half], b[:cut], most_bits) + [half + i for i in _subsequence(a[half:], b[cut:], most_bits)]
    rows, found, i, j = list(_rows(a, b)), [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1  # line j of b adds nothing here
        elif i and not rows[i - 1] >> j & 1:
            i -= 1  # it does so already without line i of a
        else:
            found.append(i)
            i, j = i - 1, j - 1
    return found[::-1]


def _keyed(pages: DataFrame) -> DataFrame:
    """``host, path, digest, keys, kinds``: each page's lines as hashes, and the kind of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [page_lines(x) for x in batch.column(2).to_pylist()]
            digests = pa.array([text_digest(x) for x in lines], pa.binary())
            keys, kinds = pa.array([line_keys(x) for x in lines], pa.list_(pa.int64())), pa.array([line_kinds(x) for x in lines], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], digests, keys, kinds], names=["host", "path", "digest", "keys", "kinds"])

    found = url_parts(pages).select("host", "path", "html")
    return found.mapInArrow(read, "host string, path string, digest binary, keys array<bigint>, kinds array<tinyint>")


def _ordered(keyed: DataFrame) -> DataFrame:
    """The pages in the order of host and path, mirrors as one page at their smallest path.

    They are sorted by range, so a host of any size spreads; of mirrors each task keeps one before the shuffle.
    """
    # Mirrors may differ in landmarks only, which the last order makes the same choice of.
    first = Window.partitionBy("host", "digest").orderBy("path", F.xxhash64("keys"))
    single = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    ordered = single.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest")
    return written(ordered.select("host", "path", "digest", "keys", "kinds", F.spark_partition_id().alias("part")), "ordered")


def _neighbours(ordered: DataFrame) -> DataFrame:
    """Every page with its neighbours; those across the edge of a range come from a table of a row per range."""
    columns = ["host", "path", "digest", "keys"]
    edges = ordered.groupBy("part").agg(F.min(F.struct(*columns)).alias("first"), F.max(F.struct(*columns)).alias("last"))
    by_part = Window.orderBy("part")
    edges = written(edges.select("part", F.lag("last").over(by_part).alias("_before"), F.lead("first").over(by_part).alias("_after")), "edges")
    inside = Window.partitionBy("part").orderBy("host", "path", "digest")
    near = ordered.select(*columns, "kinds", "part", F.lag(F.struct(*columns)).over(inside).alias("prev"), F.lead(F.struct(*columns)).over(inside).alias("next"))
    near = near.join(edges, "part").withColumns({"prev": F.coalesce("prev", "_before"), "next": F.coalesce("next", "_after")})
    # A neighbour of another host has nothing to tell.
    useful = lambda other: F.col(f"{other}.host") == F.col("host")
    each = [F.when(useful(x), F.col(f"{x}.{c}")).alias(f"{x}_{c}") for x in ("prev", "next") for c in ("path", "keys")]
    return near.select("host", "digest", "keys", "kinds", "path", *each).where("prev_keys IS NOT NULL OR next_keys IS NOT NULL")


def nearest(path: str, before: str | None, after: str | None) -> bool:
    """Whether the neighbour before is the nearer one: its path has the longer common beginning, or as long a one."""
    alike = lambda other: -1 if other is None else len(os.path.commonprefix((path, other)))
    return alike(before) >= alike(after)


def _shared(near: DataFrame) -> DataFrame:
    """``host, digest, n_shared, left, asked``: what the nearest neighbour shares, by position among the lines outside landmarks.

    ``left`` are lines outside the declared article; ``asked`` those in it, with their keys.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, left, asked = [], [], []
            for keys, kinds, path, before, before_keys, after, after_keys in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                partner = before_keys if nearest(path, before, after) else after_keys
                shared = common_lines(np.array(keys, np.int64), np.array(partner, np.int64))
                at = (np.cumsum(np.array(kinds, np.int64) != LANDMARK) - 1).tolist()
                sizes.append(len(shared))
                left.append([at[i] for i in shared if kinds[i] == BODY])
                asked.append([{"at": at[i], "key": keys[i]} for i in shared if kinds[i] == ARTICLE])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("key", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int32()), pa.array(left, pa.list_(pa.int32())), pa.array(asked, kind)],
                names=["host", "digest", "n_shared", "left", "asked"],
            )

    return near.mapInArrow(align, "host string, digest binary, n_shared int, left array<int>, asked array<struct<at: int, key: bigint>>")


def _site_lines(ordered: DataFrame, asked: DataFrame) -> DataFrame:
    """``host, key`` of the asked lines that the site at large has; mirrors count as one page."""
    bits = ordered.sparkSession.sparkContext.broadcast(bit_filter(asked, "key"))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            hit = in_filter(bits.value, flat) if len(flat) else np.zeros(0, bool)
            at = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(flat[hit])], names=["host", "digest", "key"])

    said = ordered.select("host", "digest", "keys").mapInArrow(few, "host string, digest binary, key bigint").distinct()
    sizes = ordered.groupBy("host").agg(F.count("*").alias("pages"))
    found = said.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= SITE_PAGES)
    return found.join(sizes, "host").where(F.col("n") >= SITE_SHARE * F.col("pages")).select("host", "key")


def _decisions(ordered: DataFrame) -> DataFrame:
    """``host, digest, n_shared, left, gone``: what goes of each page, and of its mirrors, that has a different neighbour."""
    shared = written(_shared(_neighbours(ordered)), "shared")
    asked = shared.select("host", "digest", F.explode("asked").alias("_asked")).select("host", "digest", "_asked.at", "_asked.key")
    part = F.pmod(F.xxhash64("digest"), F.lit(PARTS)).alias("part")
    site = written(_site_lines(ordered, asked), "site").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    gone = asked.withColumn("part", part).join(site, ["host", "key", "part"]).groupBy("host", "digest").agg(F.collect_list("at").alias("gone"))
    return shared.select("host", "digest", "n_shared", "left").join(gone, ["host", "digest"], "left")


def main_text(texts: list[str], own: list[bool], left: list[int] | None, gone: list[int] | None = None) -> str:
    """The text of a page from its lines outside landmarks.

    ``left`` are the shared lines outside the declared article, null without a neighbour; ``gone`` are those in it that the site has.
    """
    if left is None:
        return "\n\n".join(t for t, x in zip(texts, own, strict=True) if x or not any(own))
    leave = {*left}.union([] if gone is None else gone)
    return "\n\n".join(t for i, t in enumerate(texts) if i not in leave)


def extracted(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Per row ``key, url, text, n_chars, n_lines, n_shared``.

    A null or empty page has an empty text; a null url has an empty host and path like any without
    ``://``.  Pages of a host with equal text outside landmarks share one decision, and equal keys do
    not matter.  An empty table gives no rows.
    """
    plain = pages.select(F.col(key).alias("_key"), "url", "html")
    decisions = written(_decisions(_ordered(_keyed(plain))), "decisions")

    @F.pandas_udf("texts array<string>, own array<boolean>, n_lines int, digest binary")
    def read(html: pd.Series) -> pd.DataFrame:
        found = []
        for lines in map(page_lines, html):
            inside = [(text, kind == ARTICLE) for (_, _, text), kind in zip(lines, line_kinds(lines), strict=True) if kind != LANDMARK]
            found.append(([t for t, _ in inside], [x for _, x in inside], len(lines), text_digest(lines)))
        return pd.DataFrame(found, columns=["texts", "own", "n_lines", "digest"])

    @F.pandas_udf("string")
    def text_of(texts: pd.Series, own: pd.Series, left: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([main_text(*x) for x in zip(texts, own, left, gone, strict=True)], dtype=object)

    pages = url_parts(plain).select("_key", "url", "host", read("html").alias("_page")).select("_key", "url", "host", "_page.*")
    met = pages.join(decisions, ["host", "digest"], "left").withColumn("text", text_of("texts", "own", "left", "gone"))
    return met.select(
        F.col("_key").alias(key), "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", F.coalesce("n_shared", F.lit(0)).alias("n_shared")
    )
