"""Removes byte strings that repeat, found in suffix order built column by column for many documents at once.

A text is read as UTF-8 bytes. A byte goes if a string of `length` bytes that covers it also starts earlier.

Where such strings can repeat is found first, exactly: of the short strings inside each the one with the smallest hash is
its anchor, so equal strings have equal anchors at equal distances. Documents lie in chunks; a chunk asks which of its
anchors occur elsewhere (exchange.py), and only there cuts segments: the bytes of all strings round one place that share
an anchor. Equal segments are pre-aggregated to the first of them. A segment's strings are dealt to cells by how far the
anchor lies inside them: all of a range of distances hold a common core, and the core's hash is the cell. A cell that has
one segment only is done with; one with more than CROWDED segments is split by halving its range, which makes its cores
longer, and its now shorter segments are pre-aggregated again, until at one distance the core is the string itself. So
no cell is ever crowded, however frequent a passage is, and none is dropped.

All other cells are put together to collections of bounded size, each sorted in one task: round j puts the j-th last
symbol of every segment in front of the suffixes placed in the round before, whose new places follow from the ranks of
these symbols in the Burrows-Wheeler transform so far; the lengths of common prefixes grow with it, each from the least
one between the two parents' places. Runs of common prefixes of full length are equal strings, of which the first stays.
A collection fits into memory, so the sequential files of the external construction are arrays here: each round reads
the transform and the prefixes of the round before from begin to end and writes them anew.

Defined results: a null text is empty, and stays null where texts are returned. Texts shorter than the length lose
nothing. Rows that repeat a doc_id with the same text are one document, with a row each. Texts under one doc_id that are
not alike are documents of their own, in the order of their SHA-256; rows without a doc_id come after all others. A text
of any length is read whole. Columns of any name are kept. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm import exchange as ex
from kinmatch.llm.common import Scratch, shuffle_partitions, table_schema

#: Length of the strings by whose hash anchors are chosen, for repeats of LENGTH bytes.
LENGTH, GRAM = 100, 64
#: Segments in a collection, in expectation, and in a cell before it is split.
COLLECTION, CROWDED = 1500, 1000
#: Bytes of text, in expectation, whose anchors a bucket of questions sees.
BUCKET_BYTES = 16 << 20
_BLOCK = 1 << 17
_RNG = np.random.default_rng(20240501)
_BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
RANGES = "chunk bigint, ranges binary"


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor hash, first start, span): stretches of starts that have one anchor.

    span: how many starts, and 256 times how far behind the first one the anchor lies.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty
    h, width, power = _BYTE_HASH[data], 1, int(_BASE)
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    least, width, grams = key, 1, length - gram + 1
    while width * 2 <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if grams > width:
        least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= length)
    counts = sizes[long] - length + 1
    owner = np.repeat(long, counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place[begin[owner] + start]
    change = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    away = at[change] - begin[owner[change]] - start[change]
    return owner[change], h[at[change]].view(np.int64), start[change], np.diff(np.append(change, len(at))) + 256 * away


def _blocks(texts: list[bytes]):
    """(first text, texts) in blocks of about _BLOCK bytes; positions in a block stay under 24 bits unless one text is longer."""
    lo, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > _BLOCK:
            yield lo, texts[lo:at]
            lo, size = at, 0
        size += len(text)
    if lo < len(texts):
        yield lo, texts[lo:]


def text_anchors(texts: list[bytes], length: int, gram: int):
    """anchors() in bounded blocks; a text too long for one is read in overlapping parts whose stretches are joined."""
    most = (1 << 23) - length
    for lo, block in _blocks(texts):
        if len(block) > 1 or len(block[0]) <= most:
            owner, h, start, n = anchors(block, length, gram)
            yield owner + lo, h, start, n
        else:
            for at in range(0, len(block[0]) - length + 1, most):
                owner, h, start, n = anchors([block[0][at : at + most + length - 1]], length, gram)
                yield owner + lo, h, start + at, n


def collection_order(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and offset of all suffixes in order, and the common prefix of each with the one before, up to length.

    Column by column from the right: bwt holds the symbol before each suffix placed so far (0: none, or not known yet).
    """
    m = len(segments)
    sizes = np.array([len(x) for x in segments])
    flat = np.frombuffer(b"".join(segments), np.uint8)
    used = np.bincount(flat, minlength=256) > 0
    symbol = np.where(used, np.cumsum(used), 0).astype(np.uint8)
    ends = np.cumsum(sizes)
    bwt, lcp = np.zeros(m, np.uint8), np.zeros(m, np.uint8)
    suffix = np.arange(m, dtype=np.int32) * 512  # segment, and length in the last nine bits
    active, place = np.arange(m), np.arange(m)
    for j in range(1, int(sizes.max()) + 1):
        going = sizes[active] >= j
        active, place = active[going], place[going]
        c = symbol[flat[ends[active] - j]]
        bwt[place] = c
        by_symbol = np.argsort(bwt, kind="stable")
        at = np.empty(len(bwt), np.int32)
        at[by_symbol] = np.arange(len(bwt), dtype=np.int32)
        at = at[place].astype(np.int64)
        unknown = len(bwt) - int(np.count_nonzero(bwt))
        order = np.argsort(at)
        active, place, c, at = active[order], place[order], c[order], at[order]
        # neighbours among the suffixes that begin with the same symbol: those placed before, and new ones
        before = by_symbol[np.maximum(at - 1, 0)]
        same_before = (at > 0) & (bwt[before] == c)
        after = by_symbol[np.minimum(at + 1, len(bwt) - 1)]
        same_after = (at + 1 < len(bwt)) & (bwt[after] == c)
        own = np.where(same_before, np.minimum(_least(lcp, before + 1, place + 1, same_before).astype(np.int64) + 1, length), 0)
        to_next = np.where(same_after, np.minimum(_least(lcp, place + 1, after + 1, same_after).astype(np.int64) + 1, length), 0)
        # all m empty suffixes come first, then suffixes by first symbol and the rank of their parent
        new = m + at - unknown
        old = np.ones(len(bwt) + len(new), bool)
        old[new] = False
        bwt, lcp, suffix = _widened(bwt, old, new, 0), _widened(lcp, old, new, own), _widened(suffix, old, new, active * 512 + j)
        follow = same_after
        lcp[new[follow] + 1] = to_next[follow]
        place = new
    who, left = suffix >> 9, suffix & 511
    return who, sizes[who] - left, lcp


def _widened(values: np.ndarray, old: np.ndarray, new: np.ndarray, added) -> np.ndarray:
    """values where old is true, and added at the places new."""
    out = np.empty(len(old), values.dtype)
    out[old] = values
    out[new] = added
    return out


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Least of values[begin:end] where wanted; ranges are not empty there."""
    out = np.zeros(len(begin), values.dtype)
    if wanted.any():
        padded = np.append(values, values.dtype.type(0))
        pairs = np.stack([begin[wanted], end[wanted]], 1).ravel()
        out[wanted] = np.minimum.reduceat(padded, pairs)[::2]
    return out


def repeated_strings(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, class) of every string of the length; equal strings have equal classes."""
    who, offset, lcp = collection_order(segments, length)
    kind = np.cumsum(lcp < length)
    full = np.fromiter(map(len, segments), np.int64)[who] - offset >= length
    return who[full], offset[full], kind[full]


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first start, number of starts) of runs of consecutive starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start, start
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] - start[first] + 1


def _cover(n_bytes: int, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Mask of the bytes that strings starting in ranges (start, n) cover."""
    edge = np.zeros(n_bytes + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


class Places:
    """The documents of a chunk in the order of documents: id, then the beginning of the digest for unlike texts of one id."""

    def __init__(self, row: dict):
        self.id = ex.unpack(row["ids"])
        self.digests = [row["digests"][at : at + 32] for at in range(0, len(row["digests"]), 32)]
        self.tag = np.frombuffer(row["digests"], ">u4")[::8].astype(np.uint32)
        self.size = ex.unpack(row["sizes"])
        known: dict = {}
        #: of each row the first in the chunk with its id and text
        self.same = np.array([known.setdefault(x, at) for at, x in enumerate(zip(self.id.tolist(), self.digests))], np.int64)

    def whole(self, length: int) -> tuple[np.ndarray, ex.FirstAsk]:
        """Documents of at least the length, one row of each, and the question which of them are the first of their text."""
        at = np.flatnonzero((self.size >= length) & (self.same == np.arange(len(self.size))))
        words = np.frombuffer(b"".join(self.digests), ">u8").reshape(-1, 4)[at].astype(np.uint64)
        return at, ex.FirstAsk(words[:, 0], (words[:, 1] >> np.uint64(32)).astype(np.uint32), self.id[at])


class Segments:
    """Stretches of strings round anchors, with the bytes they lie in.

    data: regions one after the other; doc, id, tag, shift: of each region, its document in the chunk and what must be
    added to a place in data for the place in the document; region, anchor, lo, hi: of each segment, the place of the
    anchor in data and the least and greatest distance of it from a string's start; cell_lo, cell_hi: the range that
    the segment belongs to.
    """

    FIELDS = ("doc", "id", "tag", "shift", "region", "anchor", "lo", "hi", "cell_lo", "cell_hi")

    def __init__(self, data: bytes, **fields: np.ndarray):
        self.data = data
        self.__dict__.update(fields)

    def packed(self) -> bytes:
        """The bytes compressed, and only those of the regions that segments lie in."""
        used, region = np.unique(self.region, return_inverse=True)
        begin, end = self._bounds()
        size = (end - begin)[used]
        moved = (np.cumsum(size) - size) - begin[used]
        data = b"".join(self.data[a:b] for a, b in zip(begin[used].tolist(), end[used].tolist()))
        kept = {"doc": self.doc[used], "id": self.id[used], "tag": self.tag[used], "shift": self.shift[used] - moved, "region": region, "anchor": self.anchor + moved[region]}
        rest = [kept.get(x, getattr(self, x)) for x in self.FIELDS]
        return ex.pack_all([np.frombuffer(zstandard.ZstdCompressor(level=3).compress(data), np.uint8), *(x.astype(np.int64) if x.dtype != np.uint32 else x for x in rest), begin[used] + moved])

    @classmethod
    def unpacked(cls, packed: bytes) -> Segments:
        data, *rest, begin = ex.unpack_all(packed)
        out = cls(zstandard.ZstdDecompressor().decompress(data.tobytes()), **dict(zip(cls.FIELDS, rest)))
        out.begin = begin
        return out

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.begin, np.append(self.begin[1:], len(self.data))

    def cut(self, which: np.ndarray) -> Segments:
        """The segments of a mask or of numbers, over the same bytes."""
        out = Segments(self.data, **{x: getattr(self, x)[which] if x in self.FIELDS[4:] else getattr(self, x) for x in self.FIELDS})
        out.begin = self.begin
        return out

    def in_cells(self, ranges: Iterable[tuple[np.ndarray, np.ndarray]]) -> Segments:
        """The parts of each segment that lie in its ranges of distances."""
        parts = []
        for cell_lo, cell_hi in ranges:
            lo, hi = np.maximum(self.lo, cell_lo), np.minimum(self.hi, cell_hi)
            part = self.cut(lo <= hi)
            keep = lo <= hi
            part.lo, part.hi, part.cell_lo, part.cell_hi = lo[keep], hi[keep], np.broadcast_to(cell_lo, lo.shape)[keep], np.broadcast_to(cell_hi, lo.shape)[keep]
            parts.append(part)
        out = parts[0].cut(slice(0, 0))
        for x in self.FIELDS[4:]:
            setattr(out, x, np.concatenate([getattr(p, x) for p in parts]))
        return out

    def __len__(self) -> int:
        return len(self.region)

    @property
    def start(self) -> np.ndarray:
        """First start of a segment's strings in its document."""
        return self.anchor - self.hi + self.shift[self.region]

    def bytes_of(self, length: int) -> list[bytes]:
        """The bytes that the strings of each segment cover."""
        begin, end = self.anchor - self.hi, self.anchor - self.lo + length
        return [self.data[a:b] for a, b in zip(begin.tolist(), end.tolist())]

    def first_ask(self, length: int) -> ex.FirstAsk:
        """Which segments are the first with their bytes. Equal bytes have their anchors alike."""
        told = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in self.bytes_of(length)), ">u8").reshape(-1, 2).astype(np.uint64)
        return ex.FirstAsk(told[:, 0] ^ self.cell_lo.astype(np.uint64), (told[:, 1] >> np.uint64(32)).astype(np.uint32), self.id[self.region], self.tag[self.region], self.start)

    def cells(self, length: int) -> np.ndarray:
        """A number for the range and the core of each segment."""
        begin, end = self.anchor - self.cell_lo, self.anchor - self.cell_hi + length
        core = (xxhash.xxh64_intdigest(self.data[a:b], s) for a, b, s in zip(begin.tolist(), end.tolist(), (self.cell_lo * 256 + self.cell_hi).tolist()))
        return np.fromiter(core, np.uint64, len(self)) & ex.SHORT

    def ranges(self) -> list[np.ndarray]:
        """(document in the chunk, first start, number of starts) of the strings."""
        return [self.doc[self.region], self.start, self.hi - self.lo + 1]


def _chunk_anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    found = [*text_anchors(texts, length, gram)]
    doc, h, start, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    # anchors are the smallest hashes of their strings: multiplied by an odd number they fill all buckets alike
    return doc, h.astype(np.int64).view(np.uint64) * _BASE & ex.SHORT, start, n % 256, n // 256


def _candidates(texts: list[bytes], places: Places, doc, start, n, away, length: int) -> Segments:
    """Segments at the anchors given, over regions that join where they overlap."""
    end = start + n + length - 1
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > np.maximum.accumulate(end + (doc << 40))[:-1] - (doc[1:] << 40))
    region = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.maximum.reduceat(end, first) if len(first) else end
    at, begin = doc[first], start[first]
    size = last - begin
    base = np.cumsum(size) - size
    data = b"".join(texts[d][a:b] for d, a, b in zip(at.tolist(), begin.tolist(), last.tolist()))
    out = Segments(data, doc=at, id=places.id[at], tag=places.tag[at], shift=begin - base, region=region, anchor=start + away - (begin - base)[region], lo=away - n + 1, hi=away, cell_lo=np.zeros_like(away), cell_hi=np.zeros_like(away))
    out.begin = base
    return out


def repeat_ranges(chunks: DataFrame, scratch: Scratch, text_col: str, length: int, gram: int, collection: int, crowded: int) -> tuple[DataFrame, DataFrame]:
    """Of written rows of ex.CHUNK: (answers which texts are the first alike, RANGES of the strings that also start earlier)."""
    if gram & (gram - 1) or gram > length or length > 255:
        raise ValueError("gram must be a power of two of at most length, and length at most 255")
    spark, wide = chunks.sparkSession, length - gram
    size = chunks.select(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2 * shuffle_partitions(spark), size // BUCKET_BYTES, 1)

    def ask_whole(row: dict):
        at, ask = Places(row).whole(length)
        if len(at):
            yield ask.asks(row["chunk"], buckets)

    no_payload = chunks.select("chunk", "ids", "digests", "sizes")
    whole = scratch.written(ex.answered(no_payload.mapInArrow(ex.per_chunk(ask_whole), ex.ASKS), ex.is_first))

    def ask_anchors(row: dict):
        _, h, *_ = _chunk_anchors(ex.texts_of(ex.rows_of(row["payload"]), text_col), length, gram)
        if len(h):
            keys, n = np.unique(h, return_counts=True)
            yield ex.asks(row["chunk"], buckets, keys, [np.minimum(n, 2).astype(np.uint8)])

    often = ex.answered(chunks.select("chunk", "payload").mapInArrow(ex.per_chunk(ask_anchors), ex.ASKS), lambda keys, n: ex.totals(keys, n) > 1)

    def candidates(row: dict, right: pa.Table):
        texts, places = ex.texts_of(ex.rows_of(row["payload"]), text_col), Places(row)
        is_text = np.array(right.column("is_text").to_pylist(), bool)
        at, ask = places.whole(length)
        read = np.zeros(len(texts), bool)
        read[at] = ask.firsts(ex.answer_of(right.filter(pa.array(is_text)), bool))
        doc, h, start, n, away = _chunk_anchors(texts, length, gram)
        _, each = np.unique(h, return_inverse=True)
        keep = ex.answer_of(right.filter(pa.array(~is_text)), bool).astype(bool)[each] & read[doc]
        return row["chunk"], _candidates(texts, places, *(x[keep] for x in (doc, start, n, away)), length).packed()

    told = often.withColumn("is_text", F.lit(False)).union(whole.withColumn("is_text", F.lit(True)))
    segments = "chunk bigint, segments binary"
    found = scratch.written(ex.with_answers(chunks, told, candidates, segments))

    def first_only(table: DataFrame) -> DataFrame:
        """The first of equal segments, and the ranges of the others."""

        def ask(row: dict):
            own = Segments.unpacked(row["segments"])
            if len(own):
                yield own.first_ask(length).asks(row["chunk"], buckets)

        def keep(row: dict, right: pa.Table):
            own = Segments.unpacked(row["segments"])
            if not len(own):
                return row["chunk"], row["segments"], ex.pack_all(own.ranges())
            first = own.first_ask(length).firsts(ex.answer_of(right, bool))
            return row["chunk"], own.cut(first).packed(), ex.pack_all(own.cut(~first).ranges())

        return scratch.written(ex.with_answers(table, ex.answered(table.mapInArrow(ex.per_chunk(ask), ex.ASKS), ex.is_first), keep, f"{segments}, ranges binary"))

    def in_cells(table: DataFrame, halve: bool) -> DataFrame:
        """Segments of cells to sort and of crowded cells, and how many; those alone in their cell are done with."""

        def dealt(row: dict) -> Segments:
            own = Segments.unpacked(row["segments"])
            return own if halve else own.in_cells([(0, wide // 2), (wide // 2 + 1, wide)])

        def ask(row: dict):
            own = dealt(row)
            if len(own):
                keys, n = np.unique(own.cells(length), return_counts=True)
                yield ex.asks(row["chunk"], buckets, keys, [n.astype(np.uint32)])

        def place(row: dict, right: pa.Table):
            own = dealt(row)
            if not len(own):
                return row["chunk"], own.packed(), 0, own.packed(), 0
            _, each = np.unique(own.cells(length), return_inverse=True)
            n = ex.answer_of(right, np.uint32)[each]
            # at one distance the segments of a cell are one string each, all first: rows of one document
            many = (n > 1) & (own.cell_lo < own.cell_hi)
            sort, split = own.cut(many & (n <= crowded)), own.cut(many & (n > crowded))
            middle = (split.cell_lo + split.cell_hi) // 2
            halves = split.in_cells([(split.cell_lo, middle), (middle + 1, split.cell_hi)])
            return row["chunk"], sort.packed(), len(sort), halves.packed(), len(halves)

        asked = ex.answered(table.mapInArrow(ex.per_chunk(ask), ex.ASKS), ex.totals)
        return scratch.written(ex.with_answers(table, asked, place, "chunk bigint, sort binary, n_sort bigint, segments binary, n_split bigint"))

    firsts = first_only(found)
    scratch.drop_others(chunks, whole, firsts)
    ranges, to_sort, halve = firsts.select("chunk", "ranges"), None, False
    while True:
        placed = in_cells(firsts.select("chunk", "segments"), halve)
        to_sort = placed.select("chunk", "sort", "n_sort") if to_sort is None else to_sort.union(placed.select("chunk", "sort", "n_sort"))
        if not placed.select(F.sum("n_split")).first()[0]:
            break
        firsts, halve = first_only(placed.select("chunk", "segments")), True
        ranges = ranges.union(firsts.select("chunk", "ranges"))

    collections = max(1, -(-(to_sort.select(F.sum("n_sort")).first()[0] or 0) // collection))

    def deal(row: dict):
        own = Segments.unpacked(row["sort"])
        if not len(own):
            return
        to = (own.cells(length) >> np.uint64(16)) % np.uint64(collections)
        order = np.argsort(to, kind="stable")
        filled, begin = np.unique(to[order], return_index=True)
        parts = [own.cut(x) for x in np.split(order, begin[1:])]
        yield pa.record_batch([pa.array(filled.astype(np.int64)), pa.array(np.full(len(filled), row["chunk"], np.int64)), pa.array([_segment_rows(x, length) for x in parts], pa.binary())], names=["collection", "chunk", "segments"])

    def order(table: pa.Table) -> pa.Table:
        rows = [_read_segment_rows(x) for x in table.column("segments").to_pylist()]
        source = np.repeat(np.arange(len(rows)), [len(x[0]) for x in rows])
        data = [s for x in rows for s in x[0]]
        doc, place_id, tag, begin = (np.concatenate(x) for x in zip(*(x[1:] for x in rows)))
        who, offset, kind = repeated_strings(data, length)
        start = begin[who] + offset
        again = ~ex.is_first(kind.astype(np.uint64), np.zeros(len(kind), np.uint32), place_id[who], tag[who], start)
        hit = np.flatnonzero(again)
        hit = hit[np.argsort(source[who[hit]], kind="stable")]
        out = np.split(hit, np.searchsorted(source[who[hit]], np.arange(1, len(rows))))
        return pa.table({"chunk": table.column("chunk"), "ranges": pa.array([ex.pack_all(_runs(doc[who[x]], start[x])) for x in out], pa.binary())})

    sorted_ranges = to_sort.select("chunk", "sort").mapInArrow(ex.per_chunk(deal), "collection bigint, chunk bigint, segments binary").groupBy("collection").applyInArrow(order, RANGES)
    ranges = scratch.written(sorted_ranges.union(ranges))
    scratch.drop_others(chunks, whole, ranges)
    return whole, ranges


def _segment_rows(own: Segments, length: int) -> bytes:
    data = own.bytes_of(length)
    packed = np.frombuffer(zstandard.ZstdCompressor(level=1).compress(b"".join(data)), np.uint8)
    return ex.pack_all([packed, np.array([len(x) for x in data], np.int64), own.doc[own.region], own.id[own.region], own.tag[own.region], own.start])


def _read_segment_rows(packed: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, sizes, *rest = ex.unpack_all(packed)
    flat = zstandard.ZstdDecompressor().decompress(data.tobytes())
    ends = np.cumsum(sizes)
    return [flat[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())], *rest


def _applied(docs: DataFrame, id_col: str, text_col: str, length: int, schema: str, make, gram: int, collection: int, crowded: int) -> DataFrame:
    """make(rows of a chunk, its texts, Places, mask of the bytes that go for each document, None for none) -> table of the schema."""
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.written(ex.chunks_of(docs, id_col, text_col))
    whole, ranges = repeat_ranges(chunks, scratch, text_col, length, gram, collection, crowded)

    def apply(row: dict, right: pa.Table) -> pa.Table:
        rows, places = ex.rows_of(row["payload"]), Places(row)
        texts = ex.texts_of(rows, text_col)
        found = right.column("ranges").to_pylist()
        of_text = right.filter(pa.array([x is None for x in found], pa.bool_()))
        gone: list[np.ndarray | None] = [None] * len(texts)
        at, ask = places.whole(length)
        for d in at[~ask.firsts(ex.answer_of(of_text, bool))].tolist():
            gone[d] = np.ones(len(texts[d]), bool)
        parts = [ex.unpack_all(x) for x in found if x is not None]
        if parts:
            doc, start, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
            by = np.argsort(doc, kind="stable")
            doc, start, n = doc[by], start[by], n[by]
            for d, lo, hi in zip(*(x.tolist() for x in (np.unique(doc), np.searchsorted(doc, np.unique(doc)), np.searchsorted(doc, np.unique(doc), side="right")))):
                gone[d] = _cover(len(texts[d]), start[lo:hi], n[lo:hi], length)
        return make(rows, texts, places, [gone[x] for x in places.same.tolist()])

    right = whole.select("chunk", "bucket", "told", F.lit(None).cast("binary").alias("ranges")).unionByName(ranges, allowMissingColumns=True)
    return ex.with_answers(chunks, right, apply, schema)


def _digest_row(data: bytes, gone: np.ndarray | None, digest: bytes) -> tuple[int, int, int, str]:
    if gone is None:
        return len(data), 0, 0, digest.hex()
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def repeats_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, collection: int = COLLECTION, crowded: int = CROWDED) -> DataFrame:
    """Bytes, removed bytes, removed runs, and the digest of what is left, of every row."""
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")

    def make(rows: pa.RecordBatch, texts: list[bytes], places: Places, gone: list) -> pa.Table:
        told = list(zip(*(_digest_row(*x) for x in zip(texts, gone, places.digests))))
        return pa.table([rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in told[:3]), pa.array(told[3], pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])

    return _applied(rows, "doc_id", "text", length, RESULT, make, gram, collection, crowded)


def _text_left(data: bytes, gone: np.ndarray) -> str:
    """Characters of which a byte stays whole only if all stay: what is left of a cut one is dropped."""
    return np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, collection: int = COLLECTION, crowded: int = CROWDED) -> DataFrame:
    """The rows, all columns kept, with repeated bytes gone from their texts; texts of which nothing is left are empty."""

    def make(rows: pa.RecordBatch, texts: list[bytes], places: Places, gone: list) -> pa.Table:
        old = rows.column(text_col).to_pylist()
        new = pa.array([x if g is None else _text_left(t, g) for x, t, g in zip(old, texts, gone)], pa.string())
        return pa.table([new if c == text_col else rows.column(c) for c in rows.schema.names], names=rows.schema.names)

    return _applied(docs, id_col, text_col, length, table_schema(docs), make, gram, collection, crowded)
