"""Main text of web pages, with a suffix array over each host's pages.

A page is cut into blocks at block-level tags. The token streams of all the
host's pages are concatenated, runs of ``width`` tokens that several different
pages share are found with suffix arrays, and a page's runs that are covered are
boilerplate: they go from both ends of the page up to the first unique run, or a
heading; unique runs, and what is repeated between them, are kept.

Marks are signals beside that. Scripts, styles, menus, headers, footers,
sidebars, forms, notices, adverts and comments that their elements, roles or class
names tell go in any case, and so do blocks of links alone at the ends. A class or
id names a part only as a whole (``sidebar``, ``cookie-notice``; not
``no-sidebar``), and never takes the page's article or main part: one inside such
an element is the text, but for parts of comments or related pages where the page
has another. Inside a marked article such a name takes neither a heading nor a
paragraph if it may be their style (``banner``, ``related``), and if all that
a page marks as text stands in parts that only names tell, these are its text. If the page marks its article (or main part), the mark is a veto: what
stands inside without any sign of a part is its text, repeated or not. The blocks
inside that are in doubt, paragraphs of such names and blocks of links alone at the
article's ends, are in the page's stream with those outside, parted where the text
stood, and go if the index finds all of one elsewhere on the host; if all of an
article is in doubt, none is.

Equal runs meet in the shard of the least hash of the k-grams inside them, as in
``repeats``, so a host with many pages is no task's own; the windows of a shard
with many distinct segments are counted by their hashes instead. Pages with equal streams are
one page: copies of an article don't make it boilerplate.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import U64, arrow, binary_column, mix64, portions, prefix_hash, ragged, span_hash, stored, text_buffer, whole_groups, word_spans
from tessera.llm.repeats import BLOCK, apart, merged, segments
from tessera.llm.run_index import suffix_array

# Element names of HTML and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("nav header footer aside form script style noscript template svg math iframe head title button select datalist textarea menu dialog object canvas audio video map noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus replies reply respond social share sharing related recommended recommendations widget widgets toolbar login signup search pagination pager skip".split()
)
#: Parts whose own articles aren't the page's, if it has another.
OTHERS = frozenset("comment comments commentlist disqus replies reply respond related recommended recommendations".split())
#: Names that may be the style of a heading or paragraph in an article, and those elements.
STYLES = frozenset("banner header masthead search related recommended widget widgets toolbar skip respond overlay modal".split())
LINES = HEADINGS | {"p", "blockquote", "pre"}
#: What may stand with a name of ``PARTS`` in a compound: ``site-footer``, ``share-buttons``.
BEFORE = frozenset("site page main top bottom primary secondary global mobile post entry article google".split())
AFTER = frozenset("area author bar block body box button buttons container form inner item items link links list meta section slot text unit wrap wrapper posts articles policy message toggle".split())
MAIN = frozenset("article content main post entry story body".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[-_]+")


@dataclass(frozen=True)
class Settings:
    """Runs of ``width`` tokens are boilerplate; k-grams of ``gram`` tokens choose shards."""

    width: int = 8
    gram: int = 3


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


NAMED, OTHER, SURE = 1, 2, 3
SPARE = 10


@lru_cache(1 << 14)
def _part(token: str) -> str:
    """The name in ``PARTS`` that a class or id stands for as a whole, or ''."""
    first, *rest = NAMES.split(token)
    if first in BEFORE and rest:
        first, *rest = rest
    return first if first in PARTS and all(x in PARTS or x in AFTER or x.isdigit() for x in rest) else ""


def _place(name: str, attributes: str, inside: bool = False) -> tuple[int, bool, bool]:
    """Whether an element (``inside`` of main text) is a page part that goes,
    whether it is main text, and whether a name leaves that in doubt.

    A part is ``SURE`` by element or role, ``NAMED`` or of ``OTHER`` articles by
    its class or id."""
    main, drop, doubt = name in ("article", "main"), SURE if name in DROPPED else 0, False
    if attributes.strip(" /\n\t\r"):
        a = _attributes(attributes)
        marked = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
        if name not in ("html", "body"):
            if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
                drop = SURE
            parts = {_part(x) for x in marked} - {""}
            styles = parts & STYLES if inside and name in LINES else set()
            parts, doubt = parts - styles, bool(styles)
            drop = drop or (OTHER if parts & OTHERS else NAMED if parts else 0)
            marked = [x.replace("_", "-") for x in marked]
            main = main or a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody" or any(x in MAIN or x.partition("-")[0] in MAIN and x.partition("-")[2] in ("content", "body", "text") for x in marked)
    return drop, main, doubt


#: Dropped elements whose text is never seen.
UNSEEN = frozenset("script style noscript template head title iframe object canvas audio video map noembed noframes datalist svg math xmp".split())
#: Open elements that, if dropped, keep an article from ending them.
KEEPERS = frozenset("section div ol ul article li".split())


class Block(NamedTuple):
    text: str
    level: int
    kept: bool
    heading: bool
    linked: bool
    named: bool  # goes by a class or id alone
    doubt: bool  # in a line of the main text with the name of a part


class _Page:
    """Blocks of a page; each with level 2 in an article, 1 in another main part, else 0
    (in articles and main parts of dropped elements less by ``SPARE``), and whether
    it may be main text; a block of a dropped element may not.

    Reads forward only: a tag that isn't closed before the page ends makes quotes
    ordinary characters from there on, and for each name the places in the stack of
    open elements are known, so the time is in proportion to the page."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.linked = True
        self.parts: tuple[list[str], list[str]] = ([], [])  # text of the block, and of dropped elements in it
        self.open: list[tuple[str, int, int, bool, bool, bool]] = []  # name, dropped, main, heading kept in a dropped header, unseen, in doubt
        self.places: dict[str, list[int]] = {}
        self.keepers = 0
        pos, n, loose = 0, len(source), False
        while pos < n:
            at = source.find("<", pos)
            self._text(source[pos : at if at >= 0 else n])
            if at < 0:
                break
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                pos = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), at):
                end = source.find(">", at)
                if end < 0:
                    self._text(source[at:])
                    break
                pos = end + 1
                continue
            m = TAG.match(source, at)
            if not m:
                self._text("<")
                pos = at + 1
                continue
            inside = None if loose else QUOTED.match(source, m.end())
            if inside:
                rest, pos = inside[1], inside.end()
            else:
                loose = True
                end = source.find(">", m.end())
                if end < 0:
                    self._text(source[at:])
                    break
                rest, pos = source[m.end() : end], end + 1
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, rest)
            if name in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, pos)
                pos = end.start() if end else n
        self._flush()

    @property
    def _state(self) -> tuple[int, int, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (0, 0, False, False, False)

    def _text(self, text: str) -> None:
        dropped, _, heading, unseen, _ = self._state
        if text and not unseen:
            self.parts[dropped > 0 and not heading].append(text)
            self.linked = self.linked and (self._last({"a"}) >= 0 or not text.strip())

    def _flush(self) -> None:
        for kept, parts in zip((True, False), self.parts):
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.blocks.append(Block(text, self._state[1], kept, self._last(HEADINGS) >= 0, self.linked, not kept and self._state[0] in (NAMED, OTHER), self._state[4]))
                parts.clear()
        self.linked = True

    def _push(self, name: str, dropped: int, main: int, heading: bool, doubt: bool) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        self.keepers += dropped > 0 and name in KEEPERS
        self.open.append((name, dropped, main, heading, self._state[3] or name in UNSEEN, self._state[4] or doubt))

    def _pop(self, size: int) -> None:
        while len(self.open) > size:
            name, dropped, *_ = self.open.pop()
            self.places[name].pop()
            self.keepers -= dropped > 0 and name in KEEPERS

    def _last(self, names: set[str] | frozenset[str]) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def _close(self, names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        at = self._last(names)
        if at >= 0 and at >= self._last(stop):
            self._pop(at)

    def _start(self, name: str, rest: str) -> None:
        if name in BLOCKS or name == "hr":
            self._flush()
            self._close({"p"}, SCOPES | {"li", "td", "th", "dd", "dt"})
        if name in CLOSES:
            self._close(CLOSES[name], SCOPES)
        if name == "br":
            self._text(" ")
        if name in VOID or name == "hr":
            return
        if name in ("article", "main"):  # ends what was left open around it
            while self.open and self.open[-1][1] and self.open[-1][0] not in ("aside", "footer", "template", "dialog") and not self.keepers:
                self._pop(len(self.open) - 1)
        dropped, main, *_ = self._state
        drop, starts, doubt = _place(name, rest, main > 0 and not dropped)
        level = 2 if name == "article" else 1
        if name in ("article", "main") and main in (0, 1) and dropped != SURE and drop != SURE:  # class names don't take it
            if OTHER in (dropped, drop) or dropped and not main:
                main = -SPARE
            elif dropped:
                level = main
            dropped = drop = 0
        starts = starts and not drop
        if starts and not dropped:
            main = max(main, level - SPARE if main < 0 else level)
        heading = dropped and bool(main) and name in HEADINGS and self.open[-1][0] in ("header", "hgroup", "div")
        heading = heading or dropped and self._state[2]
        self._push(name, max(dropped, drop), main, bool(heading), doubt)

    def _end(self, name: str) -> None:
        at = self._last({name})
        if name == "p" and at < 0:
            self._flush()
            return
        if name in BLOCKS:
            self._flush()
        if at >= 0 and (name in BLOCKS or name in SCOPES or at >= self._last(SCOPES)):
            self._pop(at)


def blocks_of(source: str) -> tuple[list[str], bool]:
    """The blocks that may be main text, and whether the page itself says so."""
    found, best = _read(source)
    return [b.text for b in found if b.kept and b.level == best], best != 0


def _read(source: str) -> tuple[list[Block], int]:
    """The blocks of a page and the level of its main text."""
    found = _Page(source).blocks
    levels = {b.level for b in found if b.kept}
    only = {b.level for b in found if b.named and b.level > 0} - levels
    if only and max(levels, default=0) <= 0:  # names never empty a page's article
        found = [b._replace(kept=b.kept or b.named and b.level == max(only)) for b in found]
        levels.add(max(only))
    return found, max({x for x in levels if x > 0} or {x for x in levels if x < 0} or {0})


#: What a block of a stream is, beside its text.
GONE, HEAD, LINKS, DOUBT = 1, 2, 4, 8


class _Stream(NamedTuple):
    marked: bool
    blocks: list[str]
    kinds: list[int]
    article: list[str]
    doubts: list[int]


def _doubts(own: list[Block]) -> list[int]:
    """Places of an article's blocks that may be parts of the page, unless all may."""
    found = {k for k, b in enumerate(own) if b.doubt and not b.heading}
    for places in (range(len(own)), reversed(range(len(own)))):
        for k in places:
            if k not in found and (own[k].heading or not own[k].linked):
                break
            found.add(k)
    return sorted(found) if len(found) < len(own) else []


def _stream(found: list[Block], best: int) -> _Stream:
    """The blocks for the host's streams; of a page with marks also its article, and
    the places in it of the blocks in doubt. Where the others stood in the
    stream, the digest of the article parts it."""
    if not best:
        return _Stream(False, [b.text for b in found], [GONE * (not b.kept) + HEAD * b.heading + LINKS * b.linked for b in found], [], [])
    own = [b for b in found if b.kept and b.level == best]
    text, doubts = [b.text for b in own], _doubts(own)
    part = "\0" + hashlib.md5("\n".join(text).encode("utf-8", "replace")).hexdigest()
    unsure = {id(own[k]) for k in doubts}
    blocks, kinds = [], []
    for b in found:
        sure = b.kept and b.level == best and id(b) not in unsure
        if not sure or not blocks or blocks[-1] != part:
            blocks.append(part if sure else b.text)
            kinds.append(DOUBT if id(b) in unsure else GONE)
    return _Stream(True, blocks, kinds, text, doubts)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()))
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            columns = zip(*(_stream(*_read(source or "")) for source in part.column("html").to_pylist()))
            made = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), *made], ["page_id", "url", "host", *_Stream._fields])


def _streams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token symbols of the pages, each token hashed with its host."""
    joined = pa.array(["\n".join(b) for b in batch.column("blocks").to_pylist()], pa.string())
    data, offsets = text_buffer(joined)
    starts, ends, per = word_spans(data, offsets)
    hosts, host_at = text_buffer(batch.column("host"))
    host = span_hash(prefix_hash(hosts), host_at[:-1], host_at[1:])
    return mix64(span_hash(prefix_hash(data), starts, ends) ^ np.repeat(host, per)), np.concatenate([[0], np.cumsum(per)])


def _scan(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "tag"))
            symbols, offsets = _streams(batch)
            for i, j in portions(offsets, 1 << 17):
                owner, start, length, shard, content, _ = segments(symbols[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], settings.width, settings.gram)
                columns = [shard.view(np.int64), content.view(np.int64), row[i + owner], tag[i + owner], start.astype(np.int32), length.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "content", "row", "tag", "start", "length"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols, offsets = _streams(batch)
        wanted = batch.column("wanted")
        per = wanted.value_lengths().to_numpy(zero_copy_only=False)
        start, length, shard, content, several = (wanted.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5))
        taken = symbols[ragged(np.repeat(offsets[:-1], per) + start, length.astype(np.int64))]
        page = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), per)
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(content), pa.array(page), pa.array(several), binary_column(taken.view(np.uint8), np.concatenate([[0], np.cumsum(8 * length.astype(np.int64))]))], ["shard", "content", "page", "several", "symbols"])


def shared_starts(symbols: np.ndarray, offsets: np.ndarray, pages: np.ndarray, several: np.ndarray, width: int) -> np.ndarray:
    """Where a run of ``width`` symbols starts that different pages hold."""
    sizes = np.diff(offsets)
    known = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    joined = np.zeros(len(symbols) + len(sizes), np.int64)
    place = np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)
    joined[place] = known + 1
    order = suffix_array(joined)
    window = np.lib.stride_tricks.sliding_window_view(np.append(joined, np.zeros(width, np.int64)), width)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 1 << 14):
        b = min(len(order), a + (1 << 14))
        new[a:b] = (window[order[a:b]] != window[order[a - 1 : b - 1]]).any(1)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    group = group[place]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    room = np.repeat(offsets[1:], sizes) - np.arange(len(symbols)) >= width
    g, o = group[room], owner[room]
    n = int(group.max()) + 1 if len(group) else 0
    low, high, many = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, bool)
    np.minimum.at(low, g, pages[o])
    np.maximum.at(high, g, pages[o])
    np.logical_or.at(many, g, several[o])
    return room & ((low < high) | many)[group]


def _index(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"], weight="symbols"):
            data, at = text_buffer(table.column("symbols"))
            symbols, all_offsets = np.frombuffer(data.tobytes(), U64), at // 8
            shard, content, page, several = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("shard", "content", "page", "several"))
            for i, j in apart(shard, all_offsets, 1 << 17):
                offsets = all_offsets[i : j + 1] - all_offsets[i]
                found = shared_starts(symbols[all_offsets[i] : all_offsets[j]], offsets, page[i:j], several[i:j], width)
                edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                owner = np.searchsorted(offsets, first, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(shard[i:j][owner]), pa.array(content[i:j][owner]), pa.array((first - offsets[owner]).astype(np.int32)), pa.array((last - offsets[owner]).astype(np.int32))], ["shard", "content", "low", "high"])

    return run


def _windows(width: int):
    """Two hashes of each run of ``width`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column("symbols"))
            symbols, offsets = np.frombuffer(data.tobytes(), U64), at // 8
            count = np.diff(offsets) - width + 1
            start, owner = ragged(offsets[:-1], count), np.repeat(np.arange(batch.num_rows), count)
            keys = [span_hash(prefix_hash(x), start, start + width).view(np.int64) for x in (symbols, mix64(symbols.copy()))]
            rows = batch.select(["shard", "content", "page", "several"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((start - offsets[owner]).astype(np.int32)), *map(pa.array, keys)], ["shard", "content", "page", "several", "low", "w1", "w2"])

    return run


def shared_runs(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """row, tag, low, high: tokens [low, high) of ``pages(row, tag, host,
    blocks)`` that other pages of the host share."""
    seen = stored(pages.transform(arrow, _scan(settings), "shard long, content long, row long, tag int, start int, length int"))
    common = seen.groupBy("shard").agg(F.min("row").alias("one"), F.max("row").alias("two")).where("one <> two").select("shard")
    kept = stored(seen.join(common, "shard"))
    distinct = kept.groupBy("shard", "content").agg(F.min(F.struct("row", "tag", "start", "length")).alias("at"), F.max("row").alias("last"))
    distinct = stored(distinct.selectExpr("shard", "content", "at.*", "at.row <> last as several"))
    wanted = distinct.groupBy("row", "tag").agg(F.collect_list(F.struct("start", "length", "shard", "content", "several")).alias("wanted"))
    pieces = pages.join(wanted, ["row", "tag"]).transform(arrow, _cut, "shard long, content long, page long, several boolean, symbols binary")
    hot = stored(distinct.groupBy("shard").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select("shard"))
    warm = not hot.isEmpty()
    pieces = stored(pieces) if warm else pieces
    cool = pieces.join(hot, "shard", "left_anti") if warm else pieces
    runs = cool.repartition("shard").sortWithinPartitions("shard").transform(arrow, _index(settings.width), "shard long, content long, low int, high int")
    if warm:
        windows = stored(pieces.join(hot, "shard").transform(arrow, _windows(settings.width), "shard long, content long, page long, several boolean, low int, w1 long, w2 long"))
        more = windows.groupBy("w1", "w2").agg(F.expr("min(page) <> max(page) or bool_or(several) as many")).where("many")
        runs = runs.union(windows.join(more, ["w1", "w2"]).selectExpr("shard", "content", "low", "low + 1"))
    return kept.join(stored(runs.distinct()), ["shard", "content"]).selectExpr("row", "tag", "start + low as low", f"start + high - 1 + {settings.width} as high")


def _own_runs(words: list[list[str]], kinds: list[int], covered: np.ndarray) -> str:
    """The blocks without those that are covered (or all links) at both ends of
    the page, and of the first and last that are left only the unique runs.
    Headings stay as they are."""
    ends = np.cumsum([0, *map(len, words)])
    rows = [(w, covered[a:b], k) for w, a, b, k in zip(words, ends, ends[1:], kinds) if not k & GONE]
    for side in (0, -1):
        while rows and not rows[side][2] & HEAD and (rows[side][2] & LINKS or rows[side][1].all()):
            rows.pop(side)
    for side in {0, len(rows) - 1} if rows else ():
        w, c, kind = rows[side]
        if not kind & HEAD:
            rows[side] = ([x for x, hit in zip(w, c) if not hit], c, kind)
    return "\n".join(" ".join(w) for w, _, _ in rows)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The own text of pages without marks, and of the others which blocks in
    doubt (0 for the first) are covered."""
    for batch in batches:
        texts, gone = [], []
        for marked, blocks, kinds, low, high in zip(*(batch.column(c).to_pylist() for c in ("marked", "blocks", "kinds", "low", "high"))):
            words = [b.split(" ") for b in blocks]
            covered = np.zeros(sum(map(len, words)), bool)
            for a, b in zip(*merged(np.array(low, np.int64), np.array(high, np.int64))) if low else ():
                covered[a:b] = True
            ends = np.cumsum([0, *map(len, words)])
            doubts = [covered[a:b].all() for a, b, k in zip(ends, ends[1:], kinds) if k & DOUBT]
            texts.append(None if marked else _own_runs(words, kinds, covered))
            gone.append(np.flatnonzero(doubts).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("tag"), pa.array(texts, pa.string()), pa.array(gone, pa.list_(pa.int32()))], ["row", "tag", "own", "gone"])


def main_text(pages: DataFrame, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages``.

    Null and empty pages have an empty text. The host is the part of the URL
    after ``//``; pages without one are of one host. Rows that repeat others get
    results of their own; other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    parsed = rows.transform(arrow, _parse, "page_id long, url string, host string, marked boolean, blocks array<string>, kinds array<int>, article array<string>, doubts array<int>")
    parsed = stored(parsed.withColumns({"row": F.xxhash64("host", "blocks", "kinds", "marked"), "tag": F.hash("blocks", "host")}))
    streams = stored(parsed.select("row", "tag", "host", "blocks", "kinds", "marked").dropDuplicates(["row", "tag"]))
    spans = shared_runs(streams, settings).groupBy("row", "tag").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    # the text of a page whose marks leave nothing in doubt needn't wait for its stream
    asked = streams.where(~F.col("marked") | F.exists("kinds", lambda k: k.bitwiseAND(DOUBT) > 0))
    none = F.array().cast("array<int>")
    asked = asked.join(spans, ["row", "tag"], "left").select("row", "tag", "marked", "blocks", "kinds", F.coalesce("low", none).alias("low"), F.coalesce("high", none).alias("high"))
    judged = asked.transform(arrow, _judge, "row long, tag int, own string, gone array<int>")
    open_ = ~F.col("marked") | (F.size("doubts") > 0)
    sure = parsed.where(~open_).select("page_id", "url", F.array_join("article", "\n").alias("text"))
    places = F.transform("gone", lambda g: F.get("doubts", g))
    left = F.array_join(F.filter("article", lambda _, i: ~F.array_contains(places, i)), "\n")
    rest = parsed.where(open_).select("page_id", "url", "marked", "article", "doubts", "row", "tag").join(judged, ["row", "tag"], "left")
    out = sure.union(rest.select("page_id", "url", F.when(F.col("marked"), left).otherwise(F.col("own")).alias("text")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
