"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into tiles: equal parts of the item, and overlapping
windows of 13 words, one from every word on, so that a quoted part of an item holds
a whole tile too. A text region within ``e`` edits of a tile of
``m`` characters shares at least ``m + 1 - q * (e + 1)`` q-grams with it, on at
most ``e + 1`` neighbouring diagonals. Shared q-grams are counted in diagonal
bands that overlap by ``e``, so that some band holds them all; bands that reach
the bound are aligned, within the band, to find the true number of edits. As tiles
overlap, q-grams are kept and first counted per item; only those on diagonals with
enough of them for some tile are counted per tile.

Both sides are compared as lower-cased letters and digits with one blank between
runs of them. Texts are read in blocks of whole documents; the tiles go to the
executors in blocks of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stable
from .tables import as_strings, collected

_ROWS = 2_000
_BLOCK = 2_000_000              # characters of documents that are looked up together (a longer text is cut with overlap)
_BANDS, _PLACES = 1 << 34, 1 << 12     # bands of a block, places in a tile: a tile, a band and a place fit one long
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Search:
    tile: int = 96              # longest tile, in compared characters
    words: int = 13             # words of a window: a verbatim quote of so many whole words is always found
    q: int = 8
    edits: float = 0.1          # edit budget as a share of the tile's length
    least: int = 8              # a tile's budget is lowered until the lemma asks for this many shared q-grams
    tiles_per_pass: int = 50_000    # at most 2 ** 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each character of the basic plane, where that is one character, and whether it is compared."""
    lower = np.arange(65_536, dtype=np.uint32)
    counts = np.zeros(65_536, bool)
    for c in range(65_536):
        if not 0xD800 <= c < 0xE000:
            x = chr(c).lower()
            counts[c] = chr(c).isalnum()
            if len(x) == 1 and ord(x) < 65_536:
                lower[c] = ord(x)
    return lower, counts


_known: list = []


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Compared characters (32 for a run of others, none at the ends) and the place of each in ``text``."""
    if not _known:
        _known.extend(_tables())
    lower, counts = _known
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, 65_535)
    letter = counts[low] | (codes > 65_535)
    codes = np.where(codes > 65_535, codes, lower[low])
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)
    at = np.flatnonzero(keep)
    if len(at) and not letter[at[-1]]:
        at = at[:-1]
    return codes[at], at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= np.uint64(1_000_003)
        h += codes[k:k + n]
    h *= _MULTIPLIER
    return h ^ (h >> np.uint64(29))


def tiles_of(text: str, tile: int, words: int = 13) -> list[tuple[int, np.ndarray]]:
    """(number, characters) of the tiles of an item, none longer than ``tile`` characters.

    Equal parts of the item have even numbers, twice their place. Windows have odd
    numbers, twice their place and one: ``words`` words, or ``tile`` characters where
    those are fewer, from every word on and from every 16th character of a longer
    word, up to the first window that reaches the item's end. A quote of ``words``
    whole words, or of any ``tile`` + 16 characters, so holds a whole tile.
    """
    codes, _ = normal(text)
    n = -(-len(codes) // tile)
    edges = [len(codes) * k // n for k in range(n + 1)] if n else []
    spans = {(a, b): 2 * a for a, b in zip(edges, edges[1:])}
    begins = [0, *(np.flatnonzero(codes == 32) + 1).tolist(), len(codes) + 1] if n else []
    for k, (a, after) in enumerate(zip(begins, begins[1:])):
        last = begins[min(k + words, len(begins) - 1)] - 1
        for start in range(a, after - 1, 16):
            end = min(last, start + tile)
            end -= int(codes[end - 1] == 32 and end - 1 > start)
            spans.setdefault((start, end), 2 * start + 1)
            if end == len(codes):
                return [(number, codes[x:y]) for (x, y), number in spans.items()]
    return []


class Index:
    """The q-grams of a block of tiles that have the same q, kept once per place of an item."""

    def __init__(self, tiles: list[np.ndarray], q: int, share: float, least: int, names: list[tuple] | None = None) -> None:
        """``names``: (item_id, number) of each tile; without them each tile is an item of its own."""
        self.tiles, self.q, self.short = tiles, q, False       # short: tiles of fewer characters than a q-gram
        m = np.array([len(t) for t in tiles])
        self.edits = np.minimum((m * share).astype(np.int64), np.maximum(0, (m + 1 - least) // q - 1))
        self.bound = m + 1 - q * (self.edits + 1)
        ids: dict = {}
        item = np.array([ids.setdefault(i, len(ids)) for i, _ in names] if names else range(len(tiles)))
        self.offset = np.array([number // 2 for _, number in names] if names else [0] * len(tiles))
        self.length = m
        # per item: the widest bands and the lowest bound of its tiles
        self.width = np.ones(int(item.max()) + 1, np.int64)
        np.maximum.at(self.width, item, self.edits + 1)
        self.fewest = np.full(len(self.width), 1 << 40)
        np.minimum.at(self.fewest, item, self.bound)
        # tiles of an item by place; ``longest`` bounds how far before a q-gram its tile can begin
        self.longest = int(m.max())
        self.by_place = np.lexsort((self.offset, item))
        self.places = item[self.by_place] * _BANDS + self.offset[self.by_place]
        hashes = [gram_hashes(t, q) for t in tiles]
        flat = np.concatenate(hashes)
        sizes = [len(h) for h in hashes]
        at = np.repeat(item * _BANDS + self.offset, sizes) + np.concatenate([np.arange(k) for k in sizes])
        order = np.lexsort((at, flat))
        flat, at = flat[order], at[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (at[1:] != at[:-1])
        flat, self.at = flat[new], at[new]
        self.grams, self.first, self.count = np.unique(flat, return_index=True, return_counts=True)
        self.bits = np.uint64(64 - max(16, int(len(flat) * 8).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.bits)), bool)
        self.seen[(self.grams >> self.bits).astype(np.int64)] = True

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, item and place in it) of shared q-grams on diagonals that hold enough for some tile."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> self.bits).astype(np.int64)])
        k = np.searchsorted(self.grams, h[at])
        k = np.minimum(k, len(self.grams) - 1)
        true = self.grams[k] == h[at]
        at, k = at[true], k[true]
        count = self.count[k]
        post = self.at[np.repeat(self.first[k] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        at = np.repeat(at, count)
        item = post // _BANDS
        diagonal = at - (post - item * _BANDS)
        width, fewest = self.width[item], self.fewest[item]
        band = diagonal // width
        # a coarse count: most diagonals hold one or two q-grams; a tile's diagonals lie in two neighbouring cells
        cells = 1 << min(20, max(8, len(at).bit_length() + 3))
        cell = band + item * 1_000_003 & cells - 1
        n = np.bincount(cell, minlength=cells)
        some = n[cell] + np.maximum(n[cell + 1 & cells - 1], n[cell - 1]) >= fewest
        return at[some], post[some]

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(tile, first diagonal) of the bands of ``codes`` that hold as many shared q-grams as the lemma asks for."""
        at, post = self.shared(codes)
        # the tiles that hold the q-gram
        low = np.searchsorted(self.places, np.maximum(post + self.q - self.longest, post // _BANDS * _BANDS))
        count = np.searchsorted(self.places, post, "right") - low
        tile = self.by_place[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        place = np.repeat(post % _BANDS, count) - self.offset[tile]
        inside = place + self.q <= self.length[tile]
        at, tile, place = np.repeat(at, count)[inside], tile[inside], place[inside]
        diagonal = at - place
        width = self.edits[tile] + 1
        band = diagonal // width
        lower = diagonal - band * width < width - 1          # also within the band before, which overlaps
        tile = np.concatenate([tile, tile[lower]])
        band = np.concatenate([band, band[lower] - 1])
        place = np.concatenate([place, place[lower]])
        key = tile * _BANDS + (band + _BANDS // 2)
        bits = min(20, max(8, len(key).bit_length() + 3))
        coarse = (key.astype(np.uint64) * _MULTIPLIER >> np.uint64(64 - bits)).astype(np.int64)
        some = np.bincount(coarse, minlength=1 << bits)[coarse] >= self.bound[tile]
        # each q-gram of the tile counts once, however often a repetitive text has it
        once = np.unique(key[some] * _PLACES + place[some]) // _PLACES
        keys, n = np.unique(once, return_counts=True)
        tile, band = keys // _BANDS, keys % _BANDS - _BANDS // 2
        enough = n >= self.bound[tile]
        return list(zip(tile[enough].tolist(), (band * (self.edits[tile] + 1))[enough].tolist()))

    def align(self, codes: np.ndarray, found: list[tuple[int, int]]) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """(tile, (edits, start, end)) of the best region on the diagonals of each band of ``found``; none beyond the budget."""
        left: dict[int, list[tuple[int, int]]] = {}
        for tile, diagonal in found:
            m, low = len(self.tiles[tile]), max(0, diagonal)
            region = codes[low:max(0, diagonal + 2 * int(self.edits[tile])) + m].tobytes()
            whole = region.find(self.tiles[tile].tobytes())
            if whole >= 0 and whole % 4 == 0:                    # unchanged, as most leaks are
                yield tile, (0, low + whole // 4, low + whole // 4 + m)
            elif self.edits[tile]:
                left.setdefault(int(self.edits[tile]), []).append((tile, diagonal))
            elif hit := banded(self.tiles[tile], codes, diagonal, 0):
                yield tile, hit
        for budget, some in left.items():
            for k in range(0, len(some), 512):
                part = some[k:k + 512]
                hits = banded_many([self.tiles[t] for t, _ in part], codes, np.array([d for _, d in part]), budget)
                yield from ((t, hit) for (t, _), hit in zip(part, hits) if hit)


def banded(tile: np.ndarray, codes: np.ndarray, diagonal: int, budget: int) -> tuple[int, int, int] | None:
    """As ``banded_many``, for one tile."""
    return banded_many([tile], codes, np.array([diagonal]), budget)[0]


def banded_many(
    tiles: list[np.ndarray], codes: np.ndarray, diagonals: np.ndarray, budget: int
) -> list[tuple[int, int, int] | None]:
    """Least edits between each tile and a region of ``codes`` whose path stays near its band; ties: the first end.

    The band holds diagonals ``diagonal`` to ``diagonal + 2 * budget``, and
    ``budget`` more on either side for paths that end in edits. All tiles advance
    together by one character a step; those that have ended keep their costs, those
    beyond the budget leave.
    """
    width = 4 * budget + 1
    far = np.int64(1 << 20)
    length = np.array([len(t) for t in tiles])
    chars = np.zeros((len(tiles), int(length.max(initial=0))), np.uint32)
    for k, t in enumerate(tiles):
        chars[k, :len(t)] = t
    place = (diagonals - budget)[:, None] + np.arange(width)     # text position at which the path stands in row 0
    cost = np.where((place >= 0) & (place <= len(codes)), 0, far)
    start = place.copy()
    steps = np.arange(width)
    out: list[tuple[int, int, int] | None] = [None] * len(tiles)
    alive = np.arange(len(tiles))
    for i in range(chars.shape[1]):
        if i % 6 == 0:                               # costs never fall from one character to the next
            near = cost.min(axis=1) <= budget
            alive, chars, place, cost, start, length = (x[near] for x in (alive, chars, place, cost, start, length))
            if not len(alive):
                return out
            edge, none = np.full((len(alive), 1), far), np.zeros((len(alive), 1), np.int64)
        at = place + i                               # character that a diagonal step consumes
        inside = (at >= 0) & (at < len(codes))
        same = inside & (codes[np.clip(at, 0, max(0, len(codes) - 1))] == chars[:, i:i + 1]) if len(codes) else inside
        step = np.where(inside, cost + ~same, far)
        skip = np.hstack([cost[:, 1:] + 1, edge])    # the tile's character has no partner
        better = skip < step
        new = np.where(better, skip, step)
        begun = np.where(better, np.hstack([start[:, 1:], none]), start)
        # runs of text characters without a partner
        run = np.minimum.accumulate(new - steps, axis=1) + steps
        source = np.maximum.accumulate(np.where(new == run, steps, 0), axis=1)
        begun = np.take_along_axis(begun, source, axis=1)
        ends = place + i + 1
        run = np.where((ends >= 0) & (ends <= len(codes)), run, far)
        on = (i < length)[:, None]
        cost, start = np.where(on, run, cost), np.where(on, begun, start)
    for k, row in enumerate(alive):
        best = int(cost[k].argmin())
        if cost[k, best] <= budget:
            out[row] = int(cost[k, best]), int(start[k, best]), int(place[k, best] + length[k])
    return out


def _indexes(rows: list, search: Search) -> list[tuple[Index, list]]:
    """Tiles of one pass by their q: the usual one, or the tile's whole length where it is shorter."""
    by_q: dict[int, list] = {}
    for r in rows:
        codes = np.array(r.codes, np.uint32)
        by_q.setdefault(min(search.q, len(codes)), []).append((r.item_id, r.place, codes))
    out = []
    for q, group in sorted(by_q.items()):
        names = [(i, p) for i, p, _ in group]
        index = Index([c for _, _, c in group], q, search.edits, search.least, names)
        index.short = q < search.q
        out.append((index, names))
    return out


def _whole_words(codes: np.ndarray, start: int, end: int) -> bool:
    """Whether no word goes on beyond either end of a region."""
    return (start == 0 or codes[start - 1] == 32) and (end == len(codes) or codes[end] == 32)


def matches_in(text: str, indexes: list[tuple[Index, list]], first_only: bool = False) -> list[tuple]:
    """(item_id, tile number, edits, start, end) in the order of start; places count the text's own characters."""
    codes, at = normal(text)
    found: dict[tuple, tuple] = {}
    longest = 4 * max((index.longest for index, _ in indexes), default=0)
    for begin in range(0, max(1, len(codes)), _BLOCK):
        part = codes[begin:begin + _BLOCK + longest]
        for index, names in indexes:
            if len(part) < index.q:
                continue
            for tile, (edits, a, b) in index.align(part, index.bands(part)):
                if b > a and (not index.short or _whole_words(codes, begin + a, begin + b)):
                    if first_only:
                        return [(*names[tile], edits, int(at[begin + a]), int(at[begin + b - 1]) + 1)]
                    key = (*names[tile], begin + a)
                    if key not in found or edits < found[key][0]:
                        found[key] = (edits, int(at[begin + a]), int(at[begin + b - 1]) + 1)
    return sorted(((i, p, *v) for (i, p, _), v in found.items()), key=lambda x: (x[3], x[0] is not None, x[0] or 0, x[1]))


def _many(texts: list[str | None], indexes: list[tuple[Index, list]], first_only: bool = False) -> Iterator[tuple[int, list[tuple]]]:
    """(row, matches) of the rows that have some. Short texts are looked up together, apart by characters in no tile."""
    pending: list[tuple[int, np.ndarray]] = []
    size = 0
    gap = np.full(8, 0xFFFFFFFF, np.uint32)

    def flush() -> Iterator[tuple[int, list[tuple]]]:
        if not pending:
            return
        edges = np.cumsum([0, *(len(c) + len(gap) for _, c in pending)])
        together = np.concatenate([x for _, c in pending for x in (c, gap)])
        rows = set()
        for index, _ in indexes:
            for tile, diagonal in index.bands(together):
                middle = diagonal + len(index.tiles[tile]) // 2
                for place in (diagonal, middle, diagonal + 2 * int(index.edits[tile]) + len(index.tiles[tile])):
                    k = int(np.searchsorted(edges, min(max(place, 0), len(together) - 1), "right")) - 1
                    rows.add(pending[k][0])
        for row in sorted(rows):
            if found := matches_in(texts[row], indexes, first_only):
                yield row, found

    for row, text in enumerate(texts):
        if not text:
            continue
        codes, _ = normal(text)
        if len(codes) > _BLOCK:
            if found := matches_in(text, indexes, first_only):
                yield row, found
            continue
        pending.append((row, codes))
        size += len(codes)
        if size >= _BLOCK:
            yield from flush()
            pending, size = [], 0
    yield from flush()


def _passes(benchmark: DataFrame, search: Search, item_id: str, text: str) -> Iterator[list]:
    """The tiles of all items in blocks of bounded size; NULL and empty items have none."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p, c.astype(np.int64)) for i, t in zip(batch.column(0).to_pylist(), as_strings(batch.column(1)))
                    if t for p, c in tiles_of(t, search.tile, search.words)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int64())))],
                names=["item_id", "place", "codes"])

    tiles = benchmark.select(F.col(item_id).cast("bigint"), F.col(text)).mapInArrow(
        tile, "item_id bigint, place int, codes array<bigint>").distinct()
    tiles = stable(tiles)
    near, each = F.xxhash64("item_id", F.expr("place div 2048")), F.xxhash64("item_id", "place", "codes")
    parts = [(1, 0, 1, 0)]              # tiles whose hashes have these remainders; neighbours on an item stay together
    while parts:
        n, k, m, j = parts.pop()
        mine = tiles.where((F.pmod(near, F.lit(n)) == k) & (F.pmod(each, F.lit(m)) == j))
        if mine.count() <= search.tiles_per_pass:
            yield collected(mine, search.tiles_per_pass, "tiles of a pass")
        elif n < 1 << 12:
            parts += [(2 * n, k, m, j), (2 * n, k + n, m, j)]
        else:                           # too many at one place, as where ids are NULL
            parts += [(n, k, 2 * m, j), (n, k, 2 * m, j + m)]


MATCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()),
    T.StructField("tile", T.IntegerType()), T.StructField("edits", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
])


def spans(
    docs: DataFrame, benchmark: DataFrame, search: Search = Search(), doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, tile, edits, start, end: each region of a whole text within the edit budget of a tile.

    ``start`` and ``end`` count the text's characters. NULL and empty texts and
    items match nothing, repeated rows match each, an empty benchmark or document
    table gives no rows. Items of fewer compared characters than a q-gram (8) must
    occur unchanged and as whole words.
    """
    out = None
    for rows in _passes(benchmark, search, item_id, item_text):
        indexes = _indexes(rows, search)

        def look(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(at, _ROWS)
                    ids = batch.column(0).to_pylist()
                    hits = [(ids[row], *m) for row, found in _many(list(as_strings(batch.column(1))), indexes)
                            for m in found]
                    columns = list(zip(*hits)) or [()] * 6
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=MATCH.fieldNames())

        part = docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(look, MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), **names: str) -> DataFrame:
    """doc_id, item_id, tiles, edits, start, end: one row per contaminated document and item, none for clean ones."""
    return spans(docs, benchmark, search, **names).groupBy("doc_id", "item_id").agg(
        F.countDistinct("tile").alias("tiles"), F.min("edits").alias("edits"),
        F.min("start").alias("start"), F.max("end").alias("end"))


def keep_uncontaminated(
    docs: DataFrame, benchmark: DataFrame, search: Search = Search(), text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without a match, with all their columns.

    Items that are a single word of fewer characters than a q-gram (8) remove
    nothing: ``no`` does not tell where a text comes from. ``spans`` reports them.
    """
    names = docs.columns
    at = names.index(text)
    for rows in _passes(benchmark, search, item_id, item_text):
        rows = [r for r in rows if len(r.codes) >= search.q or 32 in r.codes]
        if not rows:
            continue
        indexes = _indexes(rows, search)

        def clean(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(begin, _ROWS)
                    keep = np.ones(batch.num_rows, bool)
                    for row, _ in _many(list(as_strings(batch.column(at))), indexes, first_only=True):
                        keep[row] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
