"""Secret scan with DataFrame functions only.

Base kinds are regular expressions: assignments, access keys and runs of hexadecimal digits. The method adds spans of
high entropy: over candidate strings (long runs of token characters) a window slides, the counts of its characters and their Shannon entropy are
kept up to date incrementally (a step changes only the counts of the character that leaves and of the one that enters), and
windows over the limit of the candidate's character class become spans, overlapping ones united. An allow-list suppresses
candidates that only look random, and windows that overlap a word of it.

Every row is judged by itself: there is no shuffle and nothing to skew. Texts without a hit cost one scan a pattern. Work is in proportion to a text's
length: long candidates and long lists of matches are taken in parts, and no pattern recurses or backtracks over what it has matched.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, text_or_empty

#: The base patterns and the least length of what they must match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter match cannot hide a longer one: both end where the run of characters ends
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Runs of token characters; an equals sign only pads at their ends, so that a name and its value are apart.
CANDIDATE = r"[A-Za-z0-9+/_-]{18,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Least entropy in bits by class of a candidate, in the order in which classes are tried: the class, its pattern, the limit.
CLASSES = [
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", 3.7),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", 3.8),
    ("letters", r"^(?=.*[a-z][A-Z])(?=.*[A-Z][a-z])[A-Za-z]+$", 4.0),
]
#: Candidates that are no secrets: UUIDs, words joined by marks, paths, one group repeated. Possessive, as what repeats can be matched in one way only.
ALLOWED = [
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9]*+(?:[A-Za-z]++[-_/=+]++)++[A-Za-z]*+[0-9]{0,4}$",
    r"^/?+(?:[A-Za-z0-9_-]{1,12}+/){2,}+[A-Za-z0-9_-]{0,12}$",
    r"^(.{1,8}?)\1{2,}.{0,8}$",
]
#: Words, in letters of any case, that no window may overlap.
ALLOWED_WORDS = ["0123456789", "1234567890", "abcdefghij", "qwertyuiop", "example", "placeholder", "changeme"]
_ANY_WORD = "(?i)" + "|".join(ALLOWED_WORDS)
#: What a character of such a word is replaced by.
BLOCKED = "!"
#: Windows of a candidate that are taken together, at most.
PART = 2048


SPANS = "array<struct<s:int,k:int,e:int>>"
_NONE = "array<struct<s:int,e:int>>"


def _walk(text: Column, pattern: str, spans: Callable[[Column, Column], Column]) -> Column:
    """Spans of a text: ``spans(hit, start)`` gives those of each leftmost match.

    Gaps and matches are cut out once and walked over in blocks of about the square root of their number, as adding to a list copies it.
    """
    none = F.array().cast(SPANS)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.char_length(part["gap"])
        own = spans(part["hit"], start)
        return F.struct((start + F.coalesce(F.char_length(part["hit"]), F.lit(0))).alias("at"), F.when(F.size(own) > 0, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def moved(acc: Column, block: Column) -> Column:
        here = F.transform(block["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), x["k"].alias("k"), (x["e"] + acc["at"]).alias("e")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], here).alias("out"))

    def walked(all_parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        many = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(all_parts)))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / many).cast("int")), lambda b: F.aggregate(F.slice(all_parts, b * many + 1, many), begin, step))
        return F.aggregate(blocks, begin, moved, lambda acc: acc["out"])

    # The lambda has the parts at hand, so that they are cut out once.
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(parts), walked))).otherwise(none)


def _base(text: Column, pattern: str, kind: int, value: int | None = None) -> Column:
    """Spans in code points of matches; if ``value`` is given, of those whose second group has so many characters."""

    def own(hit: Column, start: Column) -> Column:
        fits = hit.isNotNull() if value is None else F.char_length(F.regexp_extract(hit, pattern, 2)) >= value
        return F.when(fits, F.array(F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + F.char_length(hit)).alias("e")))).otherwise(F.array().cast(SPANS))

    return _walk(text, pattern, own)


def _entropy_hits(codes: Column, limit: Column) -> Column:
    """Spans ``(s, e)`` that windows of high entropy unite to. ``codes`` has the characters' places in the alphabet, 0 for a blocked one.

    ``sum`` is the sum of n log2 n over the counts n of the window's characters; the entropy is log2(w) - sum / w.
    """
    w, none = WINDOW, F.array().cast(_NONE)
    xlogx = F.array(*[F.lit(n * log2(n) if n else 0.0) for n in range(w + 1)])

    def put(counts: Column, code: Column, more: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code), F.array(F.get(counts, code) + more), F.slice(counts, code + 2, F.lit(len(ALPHABET) + 1)))

    def leave(acc: Column, at: Column) -> Column:
        code = F.get(codes, at - w)
        n = F.get(acc["counts"], code)
        return F.when(at >= w, F.struct(put(acc["counts"], code, -1).alias("counts"), (acc["sum"] + F.get(xlogx, n - 1) - F.get(xlogx, n)).alias("sum"))).otherwise(F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))

    def enter(acc: Column, at: Column) -> Column:
        code = F.get(codes, at)
        n = F.get(acc["counts"], code)
        return F.struct(put(acc["counts"], code, 1).alias("counts"), (acc["sum"] + F.get(xlogx, n + 1) - F.get(xlogx, n)).alias("sum"))

    def note(now: Column, acc: Column, at: Column) -> Column:
        start, end = at - (w - 1), at + 1
        high = (at >= w - 1) & (F.get(now["counts"], F.lit(0)) == 0) & (log2(w) - now["sum"] / w >= limit - 1e-9)
        joins = high & (acc["e"] >= start)
        closed = F.when(high & ~joins & (acc["e"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])
        return F.struct(
            now["counts"].alias("counts"), now["sum"].alias("sum"), F.when(high & ~joins, start).otherwise(acc["s"]).alias("s"), F.when(high, end).otherwise(acc["e"]).alias("e"), closed.alias("out")
        )

    def step(acc: Column, at: Column) -> Column:
        # A lambda over one value holds it, so that it is computed once.
        left = F.transform(F.array(leave(acc, at)), lambda x: enter(x, at))
        return F.get(F.transform(left, lambda now: note(now, acc, at)), F.lit(0))

    begin = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("s"), F.lit(-1).alias("e"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda acc: F.when(acc["e"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"]))


def _united(spans: Column) -> Column:
    """Spans ``(s, e)`` in order, those that overlap or touch united."""

    def add(acc: Column, x: Column) -> Column:
        joins = x["s"] <= acc["e"]
        closed = F.when(~joins & (acc["e"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])
        return F.struct(F.when(joins, acc["s"]).otherwise(x["s"]).alias("s"), x["e"].alias("e"), closed.alias("out"))

    begin = F.struct(F.lit(0).alias("s"), F.lit(-1).alias("e"), F.array().cast(_NONE).alias("out"))
    return F.aggregate(spans, begin, add, lambda acc: F.when(acc["e"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"]))


def _limit(candidate: Column) -> Column:
    """The least entropy for a candidate's class; null if it has none or is on the allow-list."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    classed = F.lit(None).cast("double")
    for _, pattern, limit in reversed(CLASSES):
        classed = F.when(candidate.rlike(pattern), F.lit(limit)).otherwise(classed)
    return F.when(~allowed & (F.char_length(candidate) >= WINDOW), classed)


def _blocked(candidate: Column) -> Column:
    """A candidate whose allowed words are blocked out, each by as many characters."""
    out = candidate
    for word in ALLOWED_WORDS:
        out = F.regexp_replace(out, f"(?i){word}", BLOCKED * len(word))
    return F.when(candidate.rlike(_ANY_WORD), out).otherwise(candidate)


def _entropy_spans(text: Column) -> Column:
    """Spans of high entropy; windows of a candidate that overlap or touch are united."""
    kind, none = F.lit(KINDS.index("entropy")), F.array().cast(SPANS)

    def in_codes(codes: Column, limit: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(codes) - WINDOW), F.lit(PART))
        parts = F.transform(starts, lambda at: F.transform(_entropy_hits_of(codes, at, limit), lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"))))
        return _united(F.flatten(parts))

    def own(candidate: Column, start: Column) -> Column:
        codes = F.transform(F.split(_blocked(candidate), ""), lambda c: F.instr(F.lit(ALPHABET), c))
        judged = F.transform(F.array(F.struct(codes.alias("codes"), _limit(candidate).alias("limit"))), lambda x: in_codes(x["codes"], x["limit"]))
        spans = F.transform(F.flatten(judged), lambda x: F.struct((start + x["s"]).alias("s"), kind.alias("k"), (start + x["e"]).alias("e")))
        return F.when(_limit(candidate).isNotNull(), spans).otherwise(none)

    return _walk(text, CANDIDATE, own)


def _entropy_hits_of(codes: Column, at: Column, limit: Column) -> Column:
    """The spans of the windows that start in one part of a candidate, from the part's begin."""
    return F.flatten(F.transform(F.array(F.slice(codes, at + 1, F.lit(PART + WINDOW - 1))), lambda part: _entropy_hits(part, limit)))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, base and entropy spans as arrays of ``(s, k, e)`` (k indexes ``KINDS``).

    Null text counts as empty and has no span. Spans are in code points with exclusive end; spans of different kinds may overlap. Keys
    may be null or repeat. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    t = F.col("t")
    rows = rows.select("k", _base(t, ASSIGN, 0, ASSIGN_VALUE).alias("assign"), _base(t, ACCESS, 1).alias("access"), _base(t, HEX, 2).alias("hex"), _entropy_spans(t).alias("entropy"))
    return rows.withColumnRenamed("k", key)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(load(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, F.col("entropy"))).alias("spans")
    )
