"""Benchmark decontamination by the q-gram lemma, with verification by banded alignment.

Texts and benchmark items are lower-cased and white space becomes one blank. An item of n bytes that occurs in a text with at most e edits
shares at least n - q + 1 - e * q of its q-grams with the place where it occurs, on diagonals (place in the text minus
place in the item) that lie within e of each other. So a text's q-grams are looked up among the items' (a bit table drops nearly
all, a binary search does the rest), shared q-grams are counted in diagonal bands of 2e + 2 that overlap by half,
and regions whose count meets the bound are aligned within a band of e. Nothing that the edit budget allows is missed.

q is 16, and 8 for items so short that 16 would leave no q-gram to count. Q-grams that repeat within an item (as in a run of one letter) would meet a text that repeats them in
very many places; they aren't looked up, and the bound is lowered by their number, which keeps it true. An item that has hardly another q-gram is
searched for by a bit-parallel alignment where a text has enough of its q-grams. Items under 8 bytes are searched for as they are.

The items are compared in blocks of bounded size, one pass over the documents for each block; a benchmark of
usual size is one block. Documents are judged row by row: there is no shuffle and nothing to skew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, small_batches, text_or_empty

#: Lengths of q-grams, for long and short items.
LONG, SHORT = 16, 8
#: Edits allowed, as a share of an item's length.
EDIT_RATE = 0.05
#: Bytes of items in one block.
BLOCK_BYTES = 8 << 20
#: Items with fewer bytes after normalisation (say, "yes") don't make a document unclean.
LEAST_BYTES = 32
#: Places in an item that a q-gram may have, to be looked up.
REPEATS = 4
_BITS = 22
_SPACE = re.compile(r"\s+")


def normalise(text: str | None) -> bytes:
    return _SPACE.sub(" ", text or "").strip().lower().encode("utf-8", "surrogatepass")


def _grams(data: bytes, q: int) -> np.ndarray:
    """A 64-bit number for each q-gram: its 8-byte parts, multiplied by odd constants and added up."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts = np.ndarray((n + q - 8,), "<u8", data, strides=(1,))
    grams = parts[:n] * np.uint64(0x9E3779B97F4A7C15)
    return grams + parts[8:] * np.uint64(0xC2B2AE3D27D4EB4F) if q == LONG else grams


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)).astype(np.int64)


class _Index:
    """The q-grams of some items, by their numbers: those that are looked up with their places, and those that repeat in an item."""

    def __init__(self, q: int, items: list[tuple[int, bytes, int]]):
        self.q, self.need, self.periodic = q, {}, {}
        flat, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for which, item, edits in items:
            grams = _grams(item, q)
            _, back, many = np.unique(grams, return_inverse=True, return_counts=True)
            rare = many[back] <= REPEATS
            need = len(grams) - edits * q
            self.need[which] = need - int((~rare).sum())
            if self.need[which] < 1:
                self.periodic[which] = (need, np.unique(grams))
                continue
            flat.append(grams[rare])
            owner.append(np.full(int(rare.sum()), which))
            place.append(np.flatnonzero(rare))
        grams = np.concatenate(flat)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[_slot(np.concatenate([grams, *[g for _, g in self.periodic.values()]]))] = True

    def meetings(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Items, diagonals and places in the item of shared q-grams, by item; and spans ``(item, begin, stop)`` in which a periodic item may occur."""
        grams = _grams(data, self.q)
        at = np.flatnonzero(self.table[_slot(grams)])
        grams = grams[at]
        spans = []
        for which, (need, own) in self.periodic.items():
            hits = at[np.isin(grams, own)]
            if len(hits) >= need:
                spans.append((which, int(hits[0]), int(hits[-1]) + self.q))
        low = np.searchsorted(self.grams, grams, "left")
        many = np.searchsorted(self.grams, grams, "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        if not len(at):
            return at, at, at, spans
        index = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        item, diagonal, place = self.owner[index], np.repeat(at, many) - self.place[index], self.place[index]
        order = np.argsort(item, kind="stable")
        return item[order], diagonal[order], place[order], spans


class Items:
    """An index of the q-grams of one block of items."""

    def __init__(self, items: list[tuple[object, str]], edit_rate: float = EDIT_RATE, least_bytes: int = 1):
        known = [(k, normalise(t)) for k, t in items]
        self.items = [(k, t) for k, t in known if len(t) >= max(1, least_bytes)]
        self.edits = [min(int(edit_rate * len(t)), max(0, (len(t) - SHORT) // SHORT)) for _, t in self.items]
        by_q: dict[int, list[tuple[int, bytes, int]]] = {LONG: [], SHORT: []}
        self.tiny = []
        for which, ((_, t), e) in enumerate(zip(self.items, self.edits)):
            if len(t) < SHORT:
                self.tiny.append(which)
            else:
                by_q[LONG if (len(t) - LONG) // LONG >= e else SHORT].append((which, t, e))
        self.indexes = [_Index(q, own) for q, own in by_q.items() if own]

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """Places ``(item, edits, start, end)`` in the normalised text, the best one for each item, in order of items."""
        if not self.items:
            return []
        data = normalise(text)
        best: dict[int, tuple[int, int, int]] = {}

        def note(which: int, hit: tuple[int, int, int] | None) -> None:
            if hit and (which not in best or hit < best[which]):
                best[which] = hit

        for which in self.tiny:
            note(which, self._exact(which, data, 0, len(data)))
        for index in self.indexes:
            item, diagonal, place, spans = index.meetings(data)
            firsts = np.flatnonzero(np.diff(item, prepend=-1))
            for first, last in zip(firsts, [*firsts[1:], len(item)]):
                which = int(item[first])
                for band in self._bands(which, index.need[which], diagonal[first:last], place[first:last]):
                    note(which, self._align(which, data, band))
            for which, begin, stop in spans:
                n = len(self.items[which][1])
                begin, stop = max(0, begin - n), min(len(data), stop + n)
                hit = self._exact(which, data, begin, stop)
                note(which, hit if hit or not self.edits[which] else _scanned(self.items[which][1], data[begin:stop], begin, self.edits[which]))
        return [(which, *best[which]) for which in sorted(best)]

    def _bands(self, which: int, need: int, diagonal: np.ndarray, place: np.ndarray) -> list[int]:
        """The lowest diagonals of bands in which enough q-grams of the item occur."""
        if len(diagonal) < need:
            return []
        # Bands of 2e + 2 diagonals start e + 1 apart, so that any e + 1 neighbouring diagonals lie in one of them.
        step, wide = self.edits[which] + 1, len(self.items[which][1]) + 1
        pairs = np.unique(np.concatenate([(diagonal // step - shift) * wide + place for shift in (0, 1)]))
        bands, counts = np.unique(pairs // wide, return_counts=True)
        return [int(b) * step for b in bands[counts >= need]]

    def _exact(self, which: int, data: bytes, begin: int, stop: int) -> tuple[int, int, int] | None:
        """The first place at which the item occurs as it is; one that allows no edit must stand between word borders."""
        pattern = self.items[which][1]
        at = data.find(pattern, begin, stop)
        while at >= 0 and not self.edits[which] and (_is_word(data[at - 1 : at]) and _is_word(pattern[:1]) or _is_word(data[at + len(pattern) : at + len(pattern) + 1]) and _is_word(pattern[-1:])):
            at = data.find(pattern, at + 1, stop)
        return (0, at, at + len(pattern)) if at >= 0 else None

    def _align(self, which: int, data: bytes, low: int) -> tuple[int, int, int] | None:
        """Least edits of the item against the text on diagonals of the band, with start and end; None beyond the budget."""
        pattern, e = self.items[which][1], self.edits[which]
        first, last = low - e, low + 3 * e + 1  # diagonals of the band's q-grams, and of those that edits lead to
        exact = self._exact(which, data, max(0, first), max(0, min(len(data), last + len(pattern))))
        return exact if exact or not e else _banded(pattern, data, first, last, e)


def _is_word(byte: bytes) -> bool:
    return bool(byte) and (byte.isalnum() or byte >= b"\x80")


def _banded(pattern: bytes, data: bytes, first: int, last: int, e: int) -> tuple[int, int, int] | None:
    """Least edits of the pattern against the data on diagonals ``first`` to ``last``, with free ends, row by row.

    A cell is for one diagonal, so a row has as many cells as the band, whatever the lengths; a row's insertions are a running minimum.
    """
    width, n = last - first + 1, len(pattern)
    before = max(0, -first)
    text = np.full(width + n + before, 256, np.int64)  # 256 is outside of the data and equals nothing
    part = np.frombuffer(data[max(0, first) : max(0, last + n)], np.uint8)
    text[before : before + len(part)] = part
    size = before + len(part)
    p, along = np.frombuffer(pattern, np.uint8), np.arange(width)
    scale = width + 1  # a cell is edits * scale + (width - start), so that the least value has the fewest edits, then the latest start
    beyond = (len(p) + 2) * scale
    cell = np.where((along < before) | (along > size), beyond, width - along)
    ramp = along * scale
    for i in range(1, n + 1):
        best = cell + np.where(text[i - 1 : i - 1 + width] == p[i - 1], 0, scale)
        best[:-1] = np.minimum(best[:-1], cell[1:] + scale)
        if i + width > size:
            best[max(0, size - i + 1) :] = beyond
        cell = np.minimum.accumulate(best - ramp) + ramp
        if cell.min() // scale > e:
            return None
    end = int(np.argmin(cell))
    edits, rest = divmod(int(cell[end]), scale)
    return (edits, first + width - rest, first + end + n) if edits <= e else None


def _scanned(pattern: bytes, region: bytes, begin: int, e: int) -> tuple[int, int, int] | None:
    """Least edits of the pattern anywhere in the region, column by column on bits (a column's differences are the bits of two integers)."""

    def ends(p: bytes, r: bytes) -> tuple[int, int]:
        places: dict[int, int] = {}
        for i, byte in enumerate(p):
            places[byte] = places.get(byte, 0) | 1 << i
        full, top = (1 << len(p)) - 1, 1 << len(p) - 1
        more, less, score, best = full, 0, len(p), (len(p) + 1, -1)
        for j, byte in enumerate(r, 1):
            same = places.get(byte, 0)
            across = ((same & more) + more ^ more) | same | less
            up, down = less | (full & ~(across | more)), more & across
            score += bool(up & top) - bool(down & top)
            up, down = up << 1, down << 1  # ends are free, so the first row stays zero
            more, less = (down | (full & ~((same | less) | up))) & full, up & (same | less) & full
            best = min(best, (score, j))
        return best

    edits, end = ends(pattern, region)
    if edits > e:
        return None
    from_end = region[max(0, end - len(pattern) - e) : end][::-1]
    for length in range(len(pattern) - edits, min(len(from_end), len(pattern) + edits) + 1):
        if _distance(pattern, from_end[:length][::-1]) == edits:
            return edits, begin + end - length, begin + end
    raise AssertionError("an end of an alignment without a start")


def _distance(a: bytes, b: bytes) -> int:
    """Edit distance, with a row at a time in numpy."""
    y = np.frombuffer(b, np.uint8)
    ramp = np.arange(len(b) + 1)
    row = ramp
    for i, x in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (y != x), row[1:] + 1)
        row = np.minimum.accumulate(best - ramp) + ramp
    return int(row[-1])


def _blocks(benchmark: DataFrame, item: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items, in lists of about ``block_bytes`` bytes."""
    size = benchmark.agg(F.sum(F.octet_length(text_or_empty(item_text)))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    listed = benchmark.select(F.col(item).alias("i"), text_or_empty(item_text).alias("t"))
    for block in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block) if blocks > 1 else listed
        yield [(r.i, r.t) for r in own.collect()]


def find_items(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` and item that occurs in it: key, item, edits, start, end (bytes of the normalised text).

    Null texts and items count as empty; they have no rows. Items that allow no edit (under 20 bytes) must stand
    between word borders. Of several places of an item the one with the fewest edits, then the first, is given. Repeated rows, keys and items give as
    many rows. Texts are searched whole, however long. Empty tables give an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    kind, item_kind = rows.schema["k"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    out = None
    for items in _blocks(benchmark, item, item_text, block_bytes):

        def of(batches: Iterator[pd.DataFrame], items: list = items) -> Iterator[pd.DataFrame]:
            index = Items(items, edit_rate)
            for batch in batches:
                owner, hits = [], []
                for row, t in enumerate(batch["t"]):
                    for which, edits, start, end in index.search(t):
                        owner.append(row)
                        hits.append((index.items[which][0], edits, start, end))
                found = pd.DataFrame(hits, columns=["i", "edits", "start", "end"])
                found.insert(0, "k", batch["k"].take(owner).to_numpy())
                yield found

        part = rows.mapInPandas(of, f"k {kind}, i {item_kind}, edits int, start long, end long")
        out = part if out is None else out.union(part)
    return out.select(F.col("k").alias(key), F.col("i").alias(item), "edits", "start", "end")


def clean(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, text: str = "text", item_text: str = "text", block_bytes: int = BLOCK_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item of ``least_bytes`` bytes or more occurs (a shorter one, say a word, proves nothing). Null and empty texts stay."""
    small_batches(docs.sparkSession)
    for items in _blocks(benchmark.select(F.lit(0).alias("i"), F.col(item_text).alias("t")), "i", "t", block_bytes):
        docs = docs.where(~_contains(items, edit_rate, least_bytes)(text_or_empty(text)))
    return docs


def _contains(items: list[tuple[object, str]], edit_rate: float, least_bytes: int):
    @F.pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Items(items, edit_rate, least_bytes)
        for batch in batches:
            yield pd.Series([bool(index.search(t)) for t in batch], dtype=bool)

    return of


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
