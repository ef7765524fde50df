"""Best-fit packing of token sequences by exact-complement hashing.

A plan is made from the histogram of piece lengths alone, which has at most ``size`` entries however large the corpus is. Long lengths come
first: the gap that a piece leaves is looked up among single lengths, then in an index of the sums of pairs, then in one of
triples; a combination that fills the gap exactly is consumed as often as the counts allow at once. What
no combination fills exactly goes by best fit, longest first, into the open sequence with the smallest sufficient gap, again
for all sequences of one kind at once. The plan is a short table: which ranks of a length go to which run of sequences and at which place.

Pieces are numbered within their length by task-local ranks plus offsets summed up over the tasks, and each finds its
sequence by binary search in the plan. No group is gathered, so a length that a third of all pieces have is no hot spot.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, load, small_batches, text_or_empty

SIZE = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Bytes of chunks and their ids that a worker keeps, with what Python needs to hold them, and of the longest chunk that is kept.
CACHED_BYTES = 64 << 20
LONGEST_CACHED = 64
_HELD = 200


# ---- tokens


#: Letters a-z and, in UTF-8, ß to ÿ.
_PLAIN_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_names() -> dict[int, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones of Latin-1 as they are, others from 256 on."""
    names, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            names[byte] = byte
        else:
            names[byte], spare = spare, spare + 1
    return names


_BYTE_NAMES = _byte_names()


class Tokens(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of chunks between white space of ASCII.

    The vocabulary's splitting never joins characters over white space, so a text's ids are those of its chunks. A chunk is
    encoded when it is first met and, unless it is long, kept; the table is emptied when it is full.
    """

    held = 0

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) > 1 and chunk[-1] in b".," and 97 <= chunk[-2] <= 122:
            # A mark after a letter is split off by the vocabulary, and the word alone is often known.
            packed = self[chunk[:-1]] + self[chunk[-1:]]
        elif _PLAIN_WORD.fullmatch(chunk):
            # One word of lower-case letters that normalisation leaves as they are: the merges alone give its ids.
            packed = np.array([token.id for token in self.model.tokenize(chunk.decode("latin-1").translate(_BYTE_NAMES))], "<u4").tobytes()
        else:
            packed = np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= LONGEST_CACHED:
            self.held += len(chunk) + len(packed) + _HELD
            if self.held > CACHED_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = packed
        return packed

    def ids(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if b"<|" not in raw:  # else it may have a special token's name, which is told by its case
            raw = raw.lower()  # A-Z only, as the vocabulary does too
        return b"".join(map(self.__getitem__, raw.split()))


_TOKENS: dict[str, Tokens] = {}


def tokens_for(path: str) -> Tokens:
    """The table of this worker, which later tasks of the worker find filled."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


# ---- the plan


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays ``length, first_rank, first_sequence, offset`` of runs, sorted by length and rank.

    A run covers the ranks of its length from ``first_rank`` up to the next run's; rank first_rank + i lies at ``offset`` in
    sequence first_sequence + i. The plan has combinations of up to three lengths, unless best fit alone takes fewer sequences.
    """
    kinds = min((_kinds(counts, size, most) for most in (3, 0)), key=lambda ks: sum(times for _, times in ks))
    ranks: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for content, times in kinds:
        offset = 0
        for length in content:
            runs.append((length, ranks[length], sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


class _Sums:
    """Lengths at hand, and an index of the sums of one, two and three of them.

    For each sum the ways to make it are tried from the most even one on, which leaves the short pieces, of use in many places, for later. As counts
    only fall, a way that is gone never comes back: each sum keeps the place of the first way that may be left, so ways are gone through once in all.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = [0] * (size + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = [total // 2 for total in range(size + 1)]  # the shorter piece, downwards
        self.triples = [-(-total // 3) for total in range(size + 1)]  # the first piece, upwards

    def at_hand(self, content: list[int]) -> bool:
        return all(self.left[x] >= content.count(x) for x in content)

    def fill(self, gap: int, own: list[int], pieces: int) -> list[int] | None:
        """``own`` with so many pieces (one to three) that fill the gap exactly, all at hand at once."""
        if pieces == 1:
            content = [*own, gap]
            return content if self.at_hand(content) else None
        return (self._pair if pieces == 2 else self._triple)(gap, own)

    def _pair(self, total: int, own: list[int]) -> list[int] | None:
        low, gone = self.pairs[total], True
        while low > 0:
            high = total - low
            if self.at_hand([low, high]):
                if self.at_hand(content := [*own, high, low]):
                    return content
                gone = False  # only taken by what is in the sequence already
            elif gone:
                self.pairs[total] = low - 1
            low -= 1
        return None

    def _triple(self, total: int, own: list[int]) -> list[int] | None:
        first, gone = self.triples[total], True
        while first <= total - 2:
            if self.left[first]:
                if content := self._pair(total - first, [*own, first]):
                    return content
                gone = gone and not self.pairs[total - first]
            if gone:
                self.triples[total] = first + 1
            first += 1
        return None


def _kinds(counts: dict[int, int], size: int, most: int) -> list[tuple[list[int], int]]:
    """Contents of sequences and how many have them; gaps are filled exactly by up to ``most`` pieces, the rest by best fit."""
    sums = _Sums(counts, size)
    left = sums.left
    kinds: list[tuple[list[int], int]] = [([size], left[size])] if left[size] else []
    left[size] = 0
    halves, total = sum(left[size // 2 + 1 :]), sum(length * n for length, n in enumerate(left))
    for pieces in range(1, most + 1):
        for big in range(size - 1, 0, -1):
            # Where pieces over half a sequence, of which each needs its own, are so many that they settle the number of
            # sequences, room isn't scarce, and a gap is better left to the longest piece that fits than to several short ones.
            while left[big] and (pieces == 1 or total > halves * size) and (content := sums.fill(size - big, [big], pieces)):
                times = min(left[x] // content.count(x) for x in content)
                for x in content:
                    left[x] -= times
                    halves -= times * (x > size // 2)
                total -= times * size
                kinds.append((content, times))

    open_by_gap: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    gaps = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        n = left[length]
        while n:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                content, times = open_by_gap[gap].pop()
                gaps[gap] = bool(open_by_gap[gap])
            else:
                gap, content, times = size, [], max(1, n // (size // length))
            each = max(1, min(gap // length, n // times)) if n >= times else 1
            used = min(times, n)
            if used < times:
                open_by_gap[gap].append((content, times - used))
                gaps[gap] = True
            rest = gap - each * length
            open_by_gap[rest].append((content + [length] * each, used))
            gaps[rest] = rest > 0
            n -= used * each
    return kinds + [x for group in open_by_gap.values() for x in group]


# ---- the operator


def pieces_of(docs: DataFrame, tokenizer: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces ``k, piece, start, length, ids_crc32, task, rank``; rank counts the pieces of one length in one task."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_for(tokenizer)
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            owner, rows = [], []
            for row, text in enumerate(batch["t"]):
                ids = tokens.ids(text) + end
                for piece, start in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[start : start + 4 * size]
                    length = len(own) // 4
                    owner.append(row)
                    rows.append((piece, start // 4, length, zlib.crc32(own), task, seen[length]))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", "task", "rank"])
            out.insert(0, "k", batch["k"].take(owner).to_numpy())
            yield out

    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInPandas(of, f"k {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and a last id 0; null and empty texts have that id alone. Documents longer than
    ``size`` are cut into pieces of ``size``, the last one may be shorter. Rows of a sequence lie gapless from 0. Repeated rows and
    keys are packed each; an empty table gives an empty result. Other columns are not read.
    """
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(pieces_of(docs, tokenizer, size, key, text), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = scratch.keep(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    counts = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    lengths, first_ranks, sequences, places = plan(counts, size)
    shift = 40  # ranks have fewer bits
    keys = (lengths << shift) | first_ranks

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = (batch["rank"] + batch["before"]).to_numpy(np.int64)
            run = np.searchsorted(keys, (batch["length"].to_numpy(np.int64) << shift) | rank, side="right") - 1
            out = batch.drop(columns=["rank", "before"])
            out["sequence_id"] = sequences[run] + rank - first_ranks[run]
            out["offset"] = places[run]
            yield out

    kind = pieces.schema["k"].dataType.simpleString()
    # As many offsets as lengths and tasks: they grow with the input, so they are merged with the pieces, not broadcast.
    ranked = pieces.join(offsets.select("length", "task", "before").hint("merge"), ["length", "task"]).select("k", "piece", "start", "length", "ids_crc32", "rank", "before")
    return ranked.mapInPandas(placed, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("k", key)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, load(spark, sf_dir, "documents"), default_tokenizer())
