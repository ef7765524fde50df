"""Near-duplicate detection on SimHash fingerprints, with Golay-code fuzzy hashing: by differing bits, or by similarity of shingles.

By bits (``near_duplicates``). A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, padded to the 23 bits of the binary Golay code.
If two fingerprints differ in at most two bits, then by the pigeonhole principle some segment has no error and
one of the other two has at most one. The perfect code decodes a segment to the one codeword within three bits; a segment one bit away has
that codeword within four. So each fingerprint is stored under six keys (an exact segment and the index of the
codeword that another segment decodes to) and looked up under the indices of all codewords within four bits, of which a segment has one or
six. Keys have 34 bits besides the pair of segments, so chance meetings stay rare in billions of fingerprints. Pairs
that meet are verified by counting differing bits.

Large groups. Only distinct fingerprints take part, so copies cost nothing. Where fingerprints of one group of near copies crowd
a key, pairs within the key would grow with the square of the group. Those fingerprints are linked instead through their
one-bit neighbourhoods: two fingerprints differ in at most two bits exactly if both are within one bit of some value,
so each sends itself to 65 values, and a value links all that it gets (65 at most) to the smallest. This is linear and misses nothing.

By similarity (``similar_documents``). Texts with a Jaccard similarity of 0.8 differ in 15 of 100 bits, far too many for a short fingerprint, so wide ones
are taken: 253 bits in eleven segments of 23, the length of the code. A segment is decoded softly: with the sums that its bits are the signs of, the code
words near it are those that flip the least sum in all, and they are found by flipping the five weakest bits in all ways and decoding each outcome. Where two
fingerprints differ, they do so in weak bits mostly, so their lists of near code words meet often. By the pigeonhole principle, of
eleven triples of segments that use each segment three times, some have no more errors than the mean, so a document goes under the
best combinations of near code words of each triple (36 bits, and the triple). Documents that share a key are candidates; those whose fingerprints differ too much
are dropped, and the rest are verified by the Jaccard similarity of their whole sets. This finds nearly all links, but not all.

Of the keys of a triple each document takes the one that most others share. There each is compared with the one that meets the most others, which is linear, and
what is linked falls into components; then another document of the key is compared with those of other components, and so on until a round adds less than a
thousandth to the links. All pairs of a key are never made: a group of near copies would give the square of its number. Texts with equal sets are one from the start.

An exact step then finds every link that is left between components (``_left``), by prefix filtering. With shingles in any one order, two sets of that similarity share one
among the first n - ceil(0.8 n) + 1 of each. Frequent shingles come last in the order; which are frequent is estimated from some of the texts, on which only the
time depends. Documents of different components that share such a shingle are verified if their sizes and parities allow it: the parities are those of the numbers of shingles in 512
buckets, of which no more can differ than the sets have shingles that aren't in both. No bound is put on how many share a shingle. The sets are cut into parts by hash, and
the pairs' differences are counted part after part, so that a part of the sets is on disk at a time.

Links go to distributed connected components. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, load, rows_marked, small_batches

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Pairs a key may give before its fingerprints are linked through their neighbourhoods.
PAIRS_PER_KEY = 4096


# ---- fingerprints


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of one text: A-Z lower-cased, words between white space of ASCII, shingles of ``words`` words, repeats included.

    Fewer words give one shingle, none the fingerprint zero. A bit is 1 if it is set in over half of the hashes.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change and only ASCII white space splits
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[: len(tokens) - words]))
    digest, n = xxhash.xxh64_intdigest, len(starts)
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, 32768):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + 32768].tolist(), (ends[words - 1 :] - 1)[at : at + 32768].tolist())], "<u8")
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * set_in > n)))


def fingerprints(text: Column, words: int = 3) -> Column:
    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.fromiter((fingerprint(t, words) for t in batch), np.uint64, len(batch)).view(np.int64))

    return of(text)


# ---- the code


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GOLAY << (bit - 11), 0)
    return left


def _patterns() -> np.ndarray:
    """For each syndrome the errors of at most four bits that have it, lightest first; -1 fills up to six."""
    table = np.full((2048, 6), -1, np.int64)
    taken = np.zeros(2048, int)
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(_syndromes(errors).tolist(), errors.tolist()):
            table[s, taken[s]] = e
            taken[s] += 1
    return table


_TABLE: np.ndarray | None = None


def codewords_near(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within four bits of each 23-bit word; the nearest comes first, -1 fills up."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _patterns()
    errors = _TABLE[_syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that fingerprints are stored under (n x 6) and looked up under (n x 36, -1 for none)."""
    bits = fps.view(np.uint64)
    segments = [((bits >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    near = [codewords_near(s) for s in segments]
    stored, looked = [], []
    for pair, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        base = (pair << 34) | (segments[i] << 12)
        stored.append(base | near[j][:, 0])
        looked.append(np.where(near[j] < 0, -1, base[:, None] | near[j]))
    return np.stack(stored, 1), np.concatenate(looked, 1)


def _keyed(fp: Column) -> Column:
    @F.pandas_udf("struct<stored: array<bigint>, looked: array<bigint>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stored, looked = keys(batch.to_numpy(np.int64))
            yield pd.DataFrame({"stored": list(stored), "looked": [r[r >= 0] for r in looked]})

    return of(fp)


# ---- links and groups


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, scratch: Scratch, pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) that connect all within two bits of each other.

    Every edge is a link; of links in crowded keys there are as many as connect what the links connect.
    """
    keyed = scratch.keep(fps.select("fp", _keyed(F.col("fp")).alias("k")).select("fp", "k.stored", "k.looked"), "keys")
    stored, looked = keyed.select("fp", F.explode("stored").alias("key")), keyed.select("fp", F.explode("looked").alias("key"))
    counts = stored.select("key", F.lit(1).alias("s"), F.lit(0).alias("l")).union(looked.select("key", F.lit(0), F.lit(1))).groupBy("key").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    crowded = scratch.keep(counts.where(F.col("s") * F.col("l") > pairs_per_key).select("key"), "crowded")
    few = stored.join(crowded, "key", "left_anti").withColumnRenamed("fp", "a").join(looked.join(crowded, "key", "left_anti").withColumnRenamed("fp", "b"), "key")
    near = few.where((F.col("a") != F.col("b")) & (_apart("a", "b") <= 2)).select("a", "b")

    many = stored.union(looked).join(crowded, "key", "left_semi").select("fp").distinct()
    values = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    met = many.select("fp", F.explode(values).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    out = scratch.keep(near.union(star).distinct(), "links")
    scratch.drop([keyed, crowded])
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text", pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """One row per row of ``docs``: key, fp (the fingerprint as a signed 64-bit integer), component_id.

    Fingerprints link at two or fewer differing bits; component_id is the smallest key that can be reached. Null and
    empty texts, and those of white space, have fingerprint zero and link like any other. Null keys are never a component's id unless
    it has no other. Repeated rows and keys give as many rows. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(spark)
    scratch = Scratch(spark, "simhash")
    marked = scratch.keep(docs.select(F.col(key).alias("k"), fingerprints(F.col(text).cast("string"), words).alias("fp")), "fingerprints")
    fps = scratch.keep(marked.groupBy("fp").agg(F.min("k").alias("k")), "distinct")
    groups = components(spark, links(fps.select("fp"), scratch, pairs_per_key), scratch).withColumnRenamed("node", "fp")
    labelled = fps.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("k").alias("component_id"))
    of_fp = scratch.keep(labelled.join(least, "component").select("fp", "component_id"), "groups")
    return marked.join(of_fp, "fp").select(F.col("k").alias(key), "fp", "component_id")


# ---- by similarity

WORDS = 5
LEAST = 0.8
#: Bits of a segment, segments of a wide fingerprint, and 64-bit numbers that hold it.
SEGMENT, WIDE, NUMBERS = 23, 11, 4
#: Triples of segments, by their distances from the first; each segment is in three of them.
TRIPLE = (0, 1, 3)
#: Weakest bits of a segment that are flipped, near code words that are listed, and combinations of a triple that give keys.
WEAK, LISTED, COMBINED = 5, 6, 10
#: Bits in which fingerprints of similar texts differ at most: the mean at a similarity of 0.8 is 38, with a deviation of 6.
MOST_BITS = 58
#: Rounds go on while one adds more than such a part of all links.
STILL = 1000
#: Shingles that come last in the order of prefixes: those found in at least so many of the texts of one in so many, and at most so many shingles.
FREQUENT, SAMPLED, LAST = 8, 8, 1 << 17
#: Parts, by their hashes, that the sets of the last pairs are cut into.
PARTS = 8
#: 64-bit numbers that hold the parities of a set.
PARITIES = 8
#: Texts that are decoded at once.
_TOGETHER = 64


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, with words as in ``fingerprint``. Fewer words give one shingle, and so do none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[: len(tokens) - words]))
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts)))


def sums(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the wide fingerprint how many more hashes have it than have it not. Each hash is drawn out to 256 bits by mixing."""
    out = np.zeros(64 * NUMBERS, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384, None] + np.arange(NUMBERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        out += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * out - len(hashes)


def codewords_by_sums(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments given by the sums of their bits (... x 23) the nearest code words' indices and what they flip (... x LISTED; infinite where there are fewer)."""
    z = np.asarray(z, np.float32)
    hard = ((z > 0).astype(np.int64) << np.arange(SEGMENT)).sum(-1)
    weak = np.argpartition(np.abs(z), WEAK, axis=-1)[..., :WEAK]
    flips = np.left_shift(1, weak) @ (np.arange(1 << WEAK) >> np.arange(WEAK)[:, None] & 1)
    tried = hard[..., None] ^ flips
    index = codewords_near(tried.ravel())[:, 0].reshape(tried.shape)
    message = index << 11
    changed = (message ^ _syndromes(message)) ^ hard[..., None]
    cost = np.einsum("...pb,...b->...p", (changed[..., None] >> np.arange(SEGMENT) & 1).astype(np.float32), np.abs(z))
    order = np.argsort(index, axis=-1, kind="stable")
    index, cost = np.take_along_axis(index, order, -1), np.take_along_axis(cost, order, -1)
    cost[..., 1:][index[..., 1:] == index[..., :-1]] = np.inf
    order = np.argsort(cost, axis=-1, kind="stable")[..., :LISTED]
    return np.take_along_axis(index, order, -1), np.take_along_axis(cost, order, -1)


_GRID = np.stack(np.meshgrid(*[np.arange(LISTED)] * 3, indexing="ij")).reshape(3, -1)


def wide_keys(z: np.ndarray) -> list[np.ndarray]:
    """The keys of fingerprints given by the sums of their bits (n x 256)."""
    index, cost = codewords_by_sums(z[:, : WIDE * SEGMENT].reshape(len(z), WIDE, SEGMENT))
    found = []
    for first in range(WIDE):
        own = [(first + d) % WIDE for d in TRIPLE]
        total = sum(cost[:, s][:, g] for s, g in zip(own, _GRID))
        best = np.argpartition(total, COMBINED - 1, axis=1)[:, :COMBINED]
        key = np.full(best.shape, first, np.int64)
        for s, g in zip(own, _GRID):
            key = key << 12 | np.take_along_axis(index[:, s], g[best], 1)
        found.append(np.where(np.isfinite(np.take_along_axis(total, best, 1)), key, -1))
    return [row[row >= 0] for row in np.concatenate(found, 1)]


def prefix(hashes: np.ndarray, last: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's sorted hashes, so many that sets with a Jaccard similarity of ``least`` share one. Those in the sorted ``last`` come last, by ``rank``."""
    size = len(hashes) - int(np.ceil(least * len(hashes) - 1e-5)) + 1
    if not len(last):
        return hashes[:size]
    at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
    late = last[at] == hashes
    first, late = hashes[~late][:size], at[late]
    return np.concatenate((first, last[late[np.argsort(rank[late])][: size - len(first)]]))


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each bucket whether the number of hashes in it is odd, as ``PARITIES`` numbers."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


_PARITIES = [f"q{i}" for i in range(PARITIES)]
_MARKED = "n int, same binary, f0 long, f1 long, f2 long, f3 long, keys array<long>, " + ", ".join(f"{q} long" for q in _PARITIES) + ", prefix array<long>"


def _lists(of: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in of]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(of).view(np.int64)))


def _marks(words: int, others: int, least: float, last: np.ndarray, rank: np.ndarray):
    """Size and 128-bit hash of the set of shingles, the fingerprint and its keys, parities and prefix; the first ``others`` columns stay."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                sets = [shingles(t.as_py(), words) for t in part.column(others)]
                z = np.stack([sums(s) for s in sets])
                bits = np.packbits(z > 0, axis=1, bitorder="little").view("<i8")
                odd = np.stack([parities(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:others], pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(NUMBERS)], _lists(wide_keys(z)),
                     *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITIES)], _lists([prefix(s, last, rank, least) for s in sets])],
                    names=[*part.schema.names[:others], "n", "same", "f0", "f1", "f2", "f3", "keys", *_PARITIES, "prefix"],
                )

    return of


def _sets(rows: DataFrame, words: int, parts: int = 1) -> DataFrame:
    """``(row, n, set0, set1 ...)`` of ``rows(row, text)``: the size of the set, and the set cut into ``parts`` by the first bits of the hashes."""
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    names = [f"set{i}" for i in range(parts)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                pieces = zip(*[np.split(s, np.searchsorted(s, cuts)) for s in sets])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), *[_lists(list(x)) for x in pieces]], ["row", "n", *names])

    return rows.select("row", "text").mapInArrow(of, ", ".join(["row long", "n int", *[f"{x} array<long>" for x in names]]))


#: What of a text its keys' rows carry: the size of its set and its fingerprint.
_FACTS = ["n", *[f"f{i}" for i in range(NUMBERS)]]


def _close(least: float) -> Column:
    """Whether the facts of a row and those of its pivot (``p`` before their names) allow their similarity."""
    bits = sum((_apart(f, f"p{f}") for f in _FACTS[2:]), _apart("f0", "pf0"))
    return (bits <= MOST_BITS) & (F.least("n", "pn") >= F.greatest("n", "pn") * F.lit(least) - 1e-6)


def _verified(sets: DataFrame, pairs: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a Jaccard similarity of ``least`` or more.

    A pair takes its sets through the shuffle, so the parts of the sets go one after the other, each on its part of the disk. A pair whose sets
    differ in more hashes than sets of their sizes may is dropped with the part that shows it; the others go through all parts.
    """
    found = pairs.select("a", "b", F.lit(0).alias("differ"))
    for part in [x for x in sets.columns if x.startswith("set")]:
        # Both sides of the joins are written tables, so that adaptive execution can split a row with very many pairs.
        x, y = (sets.select(F.col("row").alias(row), F.col("n").alias(size), F.col(part).alias(own)) for row, size, own in (("a", "m", "x"), ("b", "n", "y")))
        both = found.join(x, "a").join(y, "b").withColumn("differ", F.col("differ") + F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y")))
        within = F.col("differ") * F.lit(1 + least) <= (F.col("m") + F.col("n")) * F.lit(1 - least) + 2e-6
        before, found = found, scratch.keep(both.where(within).select("a", "b", "differ"), "similar")
        scratch.drop([before])
    return found.select("a", "b")


def _frequent(rows: DataFrame, words: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles and their places in the order by frequency. Any answer is right; a good one saves time."""
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select(F.lit(0).cast("long").alias("row"), "text")
    counts = _sets(some, words).select(F.explode("set0").alias("h")).groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") >= FREQUENT)
    # Written, as what is collected from a shuffle keeps the shuffle's files.
    counts = scratch.keep(counts, "frequent")
    most = counts.orderBy(F.desc("m"), "h").limit(LAST).select("h").collect()
    scratch.drop([counts])
    hashes = np.array([r.h for r in most], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(hashes) - order


def _left(rows: DataFrame, marked: DataFrame, facts: DataFrame, named: DataFrame, groups: DataFrame, words: int, least: float, scratch: Scratch) -> DataFrame:
    """All links ``(a, b)`` between rows of different ``groups``. ``marked``, which has the prefixes, is deleted when they are read."""
    # Of equal sets only the first takes part. Both tables of each join grow with the input, so they are merged at every size.
    shared = marked.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    shared = scratch.keep(shared, "shared")
    firsts = marked.join(named.where("row = first").select("row").hint("merge"), "row", "left_semi").select("row", F.explode("prefix").alias("h"))
    met = scratch.keep(firsts.join(shared.hint("merge"), "h"), "met")
    scratch.drop([marked])
    known = scratch.keep(met.join(groups.select(F.col("node").alias("row"), "component"), "row", "left").select("h", "row", F.coalesce("component", "row").alias("c")), "known")
    mixed = scratch.keep(known.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("h"), "mixed")
    told = ["n", *_PARITIES]
    apart = scratch.keep(known.join(mixed, "h").join(facts.select("row", *told), "row"), "apart")
    scratch.drop([shared, met, known, mixed])
    other = apart.select("h", F.col("row").alias("prow"), F.col("c").alias("pc"), *[F.col(f).alias(f"p{f}") for f in told])
    odd = sum((_apart(q, f"p{q}") for q in _PARITIES[1:]), _apart("q0", "pq0"))
    allowed = (odd * F.lit(1 + least) <= (F.col("n") + F.col("pn")) * F.lit(1 - least) + 1e-5) & (F.least("n", "pn") >= F.greatest("n", "pn") * F.lit(least) - 1e-6)
    pairs = apart.join(other, (apart.h == other.h) & (F.col("row") < F.col("prow")) & (F.col("c") != F.col("pc")) & allowed).select(F.col("row").alias("a"), F.col("prow").alias("b")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    ids = scratch.keep(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct().join(facts.select("row", "mark"), "row"), "ids")
    scratch.drop([apart])
    sets = scratch.keep(_sets(rows.join(ids.hint("merge"), "mark"), words, PARTS), "sets")
    found = _verified(sets, pairs, least, scratch)
    scratch.drop([pairs, ids, sets])
    return found


def similar_documents(spark: SparkSession, docs: DataFrame, words: int = WORDS, least: float = LEAST, key: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """One row per row of ``docs``: key, component_id, kept, and ``mark`` if a column of that name is given.

    Rows link if the Jaccard similarity of their shingles of ``words`` words is ``least`` or more; component_id is the smallest key that can be reached,
    and ``kept`` is true for one row of each component, that with the smallest key, null last. No link is left out. ``mark`` names a column that tells rows apart, as ``common.rows_marked`` makes
    it. Null and empty texts and those of white space equal each other; texts of fewer words are one shingle. Whole texts are read, however long. Repeated
    rows and keys give as many rows. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(spark)
    scratch = Scratch(spark, "similar")
    own = mark or "mark"
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), *([F.col(mark)] if mark else []))
    rows = (rows if mark else rows_marked(spark, rows, own, scratch)).select("k", F.col(own).alias("mark"), "text")
    kinds = rows.select("k", "mark").schema
    marks = rows.select("k", "mark", "text").mapInArrow(_marks(words, 2, least, *_frequent(rows, words, scratch)), ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kinds], _MARKED]))
    marked = scratch.keep(marks.withColumn("row", F.monotonically_increasing_id()), "marked")
    # Keys and prefixes take most of the disk, so what is needed without them stands by itself.
    facts = scratch.keep(marked.drop("keys", "prefix"), "facts")
    first = scratch.keep(facts.groupBy("same", "n").agg(F.min("row").alias("first")), "first")
    named = scratch.keep(facts.select("row", "k", "same", "n").join(first, ["same", "n"]).select("row", "k", "first"), "named")

    # Keys of one row only are counted away; what is left goes by the first row with the same set, so that copies cost nothing further.
    keyed = marked.select("row", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    # Both tables grow with the input, so they are merged at every size; a broadcast would hold for small inputs only.
    met = scratch.keep(keyed.join(scratch.keep(shared, "shared").hint("merge"), "key"), "met")
    members = scratch.keep(met.join(named.select("row", "first"), "row").select("key", F.col("first").alias("row")).distinct(), "members")
    scratch.drop([first, met])
    sizes = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    sized = scratch.keep(members.join(scratch.keep(sizes, "sizes"), "key"), "sized")
    scratch.drop([members])
    # A row that meets very many others lies in the midst of them, so it is the one to compare the others of its keys with.
    weights = sized.groupBy("row").agg(F.sum("m").alias("weight")).join(facts.select("row", "mark", *_FACTS), "row")
    weights = scratch.keep(weights, "weights")
    # Of a triple's keys each row takes the one that most rows share.
    taken = sized.groupBy("row", F.shiftright("key", 36)).agg(F.max(F.struct("m", "key")).alias("x")).select("row", "x.key")
    members = scratch.keep(taken.join(weights, "row").select("key", "row", "weight", *_FACTS), "weighed")
    # The texts of documents that meet others are shuffled once, for their sets.
    sets = scratch.keep(_sets(rows.join(weights.select("row", "mark").hint("merge"), "mark"), words), "sets")
    scratch.drop([sized, weights])
    groups, links, tested, rest, many = None, None, None, members, 0
    while True:
        # In each key one more row is compared with the others of the key that it isn't connected with.
        if groups is None:
            known = rest.withColumn("c", F.col("row"))
            open_ = known
        else:
            known = scratch.keep(rest.join(groups.select(F.col("node").alias("row"), "component"), "row", "left").select(*rest.columns, F.coalesce("component", "row").alias("c")), "known")
            # A row outside of the component in whose midst the key has been compared already.
            heads = known.groupBy("key").agg(F.max(F.struct("weight", "c")).alias("h"), F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key", F.col("h.c").alias("head"))
            open_ = known.join(scratch.keep(heads, "heads"), "key").where("c <> head")
        pivots = open_.groupBy("key").agg(F.max(F.struct("weight", (-F.col("row")).alias("row"), "c", *_FACTS)).alias("p"))
        pivots = scratch.keep(pivots.select("key", (-F.col("p.row")).alias("pivot"), F.col("p.c").alias("own"), *[F.col(f"p.{f}").alias(f"p{f}") for f in _FACTS]), "pivots")
        pairs = known.join(pivots, (known.key == pivots.key) & (F.col("c") != F.col("own")) & _close(least)).select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")).distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        fresh = scratch.keep(pairs, "tested")
        found = _verified(sets, fresh, least, scratch)
        new = found.count()
        if new or groups is None:
            links = found if links is None else links.union(found)
            groups = components(spark, links, scratch)
        many += new
        if new * STILL <= many:
            break
        tested = fresh if tested is None else tested.union(fresh)
        rest = known.select(*members.columns).join(pivots.select("key", F.col("pivot").alias("row")), ["key", "row"], "left_anti")
    scratch.drop([members, sets])
    found = _left(rows, marked, facts, named, groups, words, least, scratch)
    if found.count():
        groups = components(spark, links.union(found), scratch)

    whole = named.join(groups.select(F.col("node").alias("first"), "component"), "first", "left").select("row", "k", F.coalesce("component", "first").alias("component"))
    whole = scratch.keep(whole, "whole")
    best = whole.groupBy("component").agg(F.min(F.struct(F.col("k").isNull().alias("z"), F.col("k").alias("k"), F.col("row").alias("row"))).alias("best"))
    out = whole.join(scratch.keep(best, "best"), "component").select("row", F.col("k"), F.col("best.k").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept"))
    if mark is None:
        return out.select(F.col("k").alias(key), "component_id", "kept")
    return out.join(facts.select("row", "mark"), "row").select(F.col("k").alias(key), "component_id", "kept", F.col("mark").alias(mark))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, load(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
