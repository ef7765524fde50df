"""Removal of repeated byte strings with difference-cover suffix arrays.

A byte goes if a string of 200 bytes that covers it also starts anywhere else. Suffixes are sorted by the difference-cover algorithm (period 3): sort
the triples at sampled places, recurse on their names until these are unique, place the remaining suffixes by merging, then compare
the first 200 bytes of neighbours. Sorting each byte's suffix of a corpus would shuffle some 24 bytes for every byte of
text several times over, so places that cannot repeat, and places that certainly do, are settled before, without loss:

1. Each 200-byte string has an anchor, the 32-byte string in it with the least hash. Equal strings have equal anchors, so the starts that
   share an anchor form a segment (one for every 80 bytes or so), and only segments whose anchor occurs again matter.
2. Where all segments with an anchor are equal as a whole, each of their starts repeats. This settles the inside of copies and long passages.
3. The segments that are left, at the ends of passages, are dealt out by anchor: equal strings meet. The distinct ones of each deal
   are joined into one text, and its difference-cover suffix array tells which starts repeat. Deals have a bounded size;
   an anchor with more distinct segments than that is settled by counting its strings, range by range, in shuffles with map-side combine instead.

Texts are shuffled once, and a second time only for documents that have segments of the third kind. Copies of a text share its results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, small_batches, text_or_empty

LENGTH = 200
ANCHOR = 32
#: Bytes of distinct segments that one suffix array is built over, about; and segments of one anchor that may be in it.
DEAL_BYTES = 1 << 18
DEAL_SEGMENTS = 4000
_BASE = 0x9E3779B97F4A7C15
_BATCH = 1 << 18


# ---- difference-cover suffix array


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of positive integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    size = int(t.max()) + 1
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with a place past the end, so that every place 0 modulo 3 has a successor
    twos = np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    names = _names(t[sampled], t[sampled + 1], t[sampled + 2], size)
    if names.max() + 1 < len(sampled):
        order = suffix_array(names + 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)  # 0 past the end
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    sorted_sampled = sampled[order]
    sorted_sampled = sorted_sampled[sorted_sampled < n]

    zeros = np.arange(0, n, 3)
    wide = len(sampled) + 2
    by_one = t[zeros] * wide + rank[zeros + 1]
    turn = np.argsort(by_one, kind="stable")
    zeros, by_one = zeros[turn], by_one[turn]
    by_two = _pairs(t[zeros], t[zeros + 1], size) * wide + rank[zeros + 2]

    first, second = sorted_sampled[sorted_sampled % 3 == 1], sorted_sampled[sorted_sampled % 3 == 2]
    first_key = t[first] * wide + rank[first + 1]
    second_key = _pairs(t[second], t[second + 1], size) * wide + rank[second + 2]
    out = np.empty(n, np.int64)
    out[np.arange(len(zeros)) + np.searchsorted(first_key, by_one) + np.searchsorted(second_key, by_two)] = zeros
    before = np.zeros(n + 3, np.int64)
    before[first] = np.searchsorted(by_one, first_key)
    before[second] = np.searchsorted(by_two, second_key)
    out[np.arange(len(sorted_sampled)) + before[sorted_sampled]] = sorted_sampled
    return out


def _pairs(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    return a * size + b


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """Dense ranks of triples."""
    if size < 1 << 20:
        return np.unique((a * size + b) * size + c, return_inverse=True)[1]
    pairs = np.unique(a * size + b, return_inverse=True)[1]
    return np.unique(pairs * size + c, return_inverse=True)[1]


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text the starts whose ``length`` bytes also start elsewhere in the texts."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    raw = np.frombuffer(b"\0".join(texts), np.uint8)
    joined[: len(raw)] = raw
    joined += 2
    joined[np.append(begins[1:] - 1, len(joined) - 1)] = 1  # between texts
    room = np.zeros(len(joined), bool)
    for b, n in zip(begins.tolist(), sizes.tolist()):
        room[b : b + max(0, n - length + 1)] = True
    order = suffix_array(joined)
    order = order[room[order]]
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    same = np.arange(len(order) - 1) if len(order) else np.zeros(0, np.int64)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[words[order[same] + at] == words[order[same + 1] + at]]
    hit = np.zeros(len(joined), bool)
    hit[order[same]] = hit[order[same + 1]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begins.tolist(), sizes.tolist())]


# ---- segments


def _rolling(buffer: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number for each ``width`` bytes (a power of two): polynomials, doubled up, then mixed."""
    h = (buffer.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    w = 1
    while w < width:
        h = h[:-w] * np.uint64(pow(_BASE, w, 1 << 64)) + h[w:]
        w *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def segments(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Arrays ``text, anchor hash, first start, starts, anchor's place`` (from the first start) of the segments of texts, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buffer) < length:
        return none, none, none, none, none
    hashes = _rolling(buffer, anchor)
    window = length - anchor + 1
    # The least hash, and of equal ones the first: its upper bits with the place below them.
    keys = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    padded = -(-len(keys) // window) * window
    grid = np.full(padded, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(keys)] = keys
    grid = grid.reshape(-1, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(buffer) - length + 1
    least = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), sizes)[:starts]
    valid = np.arange(starts) + length <= ends[text_of]
    place = np.where(valid, place, -1)
    edge = np.flatnonzero(np.diff(place, prepend=-2) | np.diff(text_of, prepend=-1))
    many = np.diff(np.append(edge, starts))
    keep = place[edge] >= 0
    edge, many = edge[keep], many[keep]
    owner = text_of[edge]
    return owner, hashes[place[edge]].view(np.int64), edge - (ends - sizes)[owner], many, place[edge] - edge


def _parts(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A very long text in parts that overlap so that each string of ``length`` bytes lies in one, with their places."""
    step = _BATCH
    for at in range(0, max(1, len(data) - length + 1), step):
        yield at, data[at : at + step + length - 1]


def _batches(texts: Iterable[str], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    rows, places, own, size = [], [], [], 0
    for row, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if len(data) < length:
            continue
        for at, part in _parts(data, length):
            rows.append(row)
            places.append(at)
            own.append(part)
            size += len(part)
            if size >= _BATCH:
                yield rows, places, own
                rows, places, own, size = [], [], [], 0
    if own:
        yield rows, places, own



def _segment_rows(length: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, places, own in _batches(batch["t"], length):
                owner, anchors, first, many, spot = segments(own, length)
                whole = np.array([xxhash.xxh3_64_intdigest(own[o][f : f + m + length - 1]) for o, f, m in zip(owner.tolist(), first.tolist(), many.tolist())], np.uint64)
                row, place = np.array(rows)[owner], np.array(places)[owner]
                yield pd.DataFrame({"a": anchors, "g": whole.view(np.int64), "x": batch["x"].to_numpy()[row], "y": batch["y"].to_numpy()[row], "s": first + place, "m": many, "p": spot})

    return of


# ---- the operator


def _united(starts: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings that start in the given runs of starts."""
    if not len(starts):
        return starts, starts
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], (starts + many + length - 1)[order]
    end = np.maximum.accumulate(end)
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:] - 1, len(end) - 1)]


def _outcome(data: bytes, starts: np.ndarray, many: np.ndarray, length: int) -> tuple:
    begin, end = _united(starts, many, length)
    kept, at = hashlib.sha256(), 0
    for b, e in zip(begin.tolist(), end.tolist()):
        kept.update(data[at:b])
        at = e
    kept.update(data[at:])
    return len(data), int((end - begin).sum()), len(begin), kept.hexdigest(), [[b, e] for b, e in zip(begin.tolist(), end.tolist())]


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs of bytes, begin and end).

    A byte of a text (UTF-8; null counts as empty) is removed if a string of ``length`` bytes that covers it starts at another place too, in the same
    text or another one; strings are judged on the input and matches never cross documents. Repeated rows are copies of each
    other like any. Keys may be null or repeat; an empty table gives an empty result. Other columns are not read.
    """
    small_batches(spark)
    scratch = Scratch(spark, "suffix-dedup")
    # A text goes by its hash (x) and its length (y).
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).withColumns({"x": F.xxhash64("t"), "y": F.octet_length("t").cast("long")})
    found = scratch.keep(rows.select("t", "x", "y").mapInPandas(_segment_rows(length), "a long, g long, x long, y long, s long, m long, p long"), "segments")
    anchors = scratch.keep(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "anchors")
    shared = scratch.keep(found.join(anchors, "a"), "shared")
    scratch.drop([found, anchors])
    kinds = scratch.keep(shared.groupBy("a").agg(F.min("g").alias("low"), F.max("g").alias("high")).select("a", (F.col("low") != F.col("high")).alias("open")), "kinds")
    again = scratch.keep(shared.join(kinds, "a").select("x", "y", "s", "m", F.when(F.col("open"), F.struct("a", "g", "p")).alias("o")).distinct(), "again")
    scratch.drop([shared, kinds])
    is_open = F.col("o").isNotNull()
    of_text = again.groupBy("x", "y").agg(
        F.array_sort(F.collect_list(F.when(~is_open, F.struct("s", "m")))).alias("closed"), F.array_sort(F.collect_list(F.when(is_open, F.struct("s", "m", "o.a", "o.g", "o.p")))).alias("left")
    )
    of_text = scratch.keep(of_text.select("x", "y", "left", *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("closed", "left") for f in "sm"]), "of-text")

    # Documents without open segments are finished; the others keep their texts for a second look.
    met = rows.join(of_text, ["x", "y"], "left")
    closed = F.coalesce(F.size("left"), F.lit(0)) == 0
    halves = scratch.keep(met.select("k", "x", "y", F.when(~closed, F.col("t")).alias("t"), F.col("closed_s"), F.col("closed_m"), "left", F.when(closed, _outcomes(length)("t", "closed_s", "closed_m")).alias("done")), "halves")
    open_rows = halves.where(F.col("t").isNotNull())

    # Distinct open segments with their bytes.
    pieces = open_rows.select(F.encode("t", "UTF-8").alias("b"), F.explode("left").alias("o")).select("o.a", "o.g", "o.p", F.substring("b", (F.col("o.s") + 1).cast("int"), (F.col("o.m") + length - 1).cast("int")).alias("b"))
    distinct = scratch.keep(pieces.groupBy("a", "g").agg(F.count("*").alias("n"), F.max("p").alias("p"), F.max("b").alias("b")), "distinct")
    sizes = distinct.groupBy("a").agg(F.count("*").alias("c"))
    crowded = scratch.keep(sizes.where(F.col("c") > DEAL_SEGMENTS).select("a"), "crowded")
    fair = distinct.join(crowded, "a", "left_anti")
    total = fair.agg(F.sum(F.length("b"))).first()[0] or 0
    deals = max(1, -(-total // DEAL_BYTES))

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [bytes(b) for b in frame["b"]]
        runs = [_runs(s) if n == 1 else [(0, len(b) - length + 1)] for s, n, b in zip(repeated_starts(texts, length), frame["n"], texts)]
        return pd.DataFrame({"a": frame["a"], "g": frame["g"], "s": [np.array([r[0] for r in own], np.int64) for own in runs], "m": [np.array([r[1] for r in own], np.int64) for own in runs]})

    judged = fair.select("a", "g", "n", "b", F.pmod(F.xxhash64("a"), F.lit(deals)).alias("deal")).groupBy("deal").applyInPandas(judge, "a long, g long, s array<long>, m array<long>")
    counted = _counted(distinct.join(crowded, "a", "left_semi"), scratch, length)
    results = scratch.keep(judged.union(counted).where(F.size("s") > 0), "results")

    # Starts in their texts, in one list for each text.
    late = again.where(is_open).select("x", "y", F.col("s").alias("at"), "o.a", "o.g").join(results, ["a", "g"])
    late = late.groupBy("x", "y").agg(F.flatten(F.collect_list(F.transform("s", lambda s: s + F.col("at")))).alias("late_s"), F.flatten(F.collect_list("m")).alias("late_m"))
    late = scratch.keep(late, "late")
    scratch.drop([again, of_text, distinct, crowded, results, *counted.parts])
    none = F.array().cast("array<long>")
    both = [F.concat(F.coalesce(f"closed_{f}", none), F.coalesce(f"late_{f}", none)) for f in "sm"]
    finished = open_rows.select("k", "x", "y", "t", "closed_s", "closed_m").join(late, ["x", "y"], "left").select("k", _outcomes(length)("t", *both).alias("done"))
    out = halves.where(F.col("t").isNull()).select("k", "done").union(finished)
    return out.select(F.col("k").alias(key), "done.*")


#: Widths of the ranges of starts by which the strings of crowded anchors are compared.
WIDTHS = (16, 4, 1)


def _counted(crowded: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """Runs of repeated starts in segments whose anchors have very many different segments: ``a, g, s, m``.

    Starts are taken in ranges by their distance from the anchor. All strings that start in a range have its core in common, so ranges are
    counted by their cores, with map-side combine: a core that occurs once repeats nowhere, and where all ranges with a
    core are equal, all their starts repeat. Ranges that are neither are cut into narrower ones; at the last width a core is a whole string.
    """
    rows, found, parts = crowded.select("a", "g", "n", "p", "b", F.lit(0).cast("long").alias("lo"), (F.length("b") - length).cast("long").alias("hi")), None, []
    for width in WIDTHS:
        w = F.lit(width)
        ranges = rows.select("*", F.explode(F.sequence(F.expr(f"(p - hi) div {width}"), F.expr(f"(p - lo) div {width}"))).alias("j"))
        last = F.col("p") - F.col("j") * w
        ranges = ranges.withColumns({"last": last, "lo": F.greatest("lo", last - w + 1), "hi": F.least("hi", last)})
        core = F.substring("b", (F.col("last") + 1).cast("int"), F.lit(length - width + 1))
        whole = F.substring("b", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + length).cast("int"))
        ranges = ranges.select("a", "g", "n", "p", "lo", "hi", F.unhex(F.md5(core)).alias("core"), F.xxhash64(whole, F.col("p") - F.col("lo"), F.col("p") - F.col("hi")).alias("h"))
        ranges = scratch.keep(ranges, f"ranges-{width}")
        cores = scratch.keep(ranges.groupBy("core").agg(F.sum("n").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).where("n > 1").select("core", (F.col("low") == F.col("high")).alias("equal")), f"cores-{width}")
        parts += [ranges, cores]
        met = ranges.join(cores, "core")
        closed = met.where("equal").select("a", "g", F.col("lo").alias("s"), (F.col("hi") - F.col("lo") + 1).alias("m"))
        found = closed if found is None else found.union(closed)
        rows = met.where("NOT equal").select("a", "g", "n", "p", "lo", "hi").join(crowded.select("a", "g", "b"), ["a", "g"])
    out = found.groupBy("a", "g").agg(F.collect_list(F.struct("s", "m")).alias("r")).select("a", "g", F.col("r.s").alias("s"), F.col("r.m").alias("m"))
    out.parts = parts
    return out


def _outcomes(length: int):
    @F.pandas_udf(_RESULT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        for texts, starts, many in batches:
            out = [_outcome(t.encode("utf-8", "surrogatepass"), none if s is None else np.asarray(s, np.int64), none if m is None else np.asarray(m, np.int64), length) for t, s, m in zip(texts, starts, many)]
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return of


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs ``(first, how many)`` of consecutive numbers."""
    if not len(starts):
        return []
    at = np.flatnonzero(np.diff(starts, prepend=starts[0] - 2) != 1)
    return list(zip(starts[at].tolist(), np.diff(np.append(at, len(starts))).tolist()))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
