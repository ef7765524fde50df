"""Text and number functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Irregular plurals.
IRREGULAR = {
    "child": "children", "person": "people", "man": "men", "woman": "women", "foot": "feet", "tooth": "teeth", "goose": "geese", "mouse": "mice", "louse": "lice", "ox": "oxen",
    "sheep": "sheep", "deer": "deer", "moose": "moose", "fish": "fish", "phenomenon": "phenomena", "criterion": "criteria", "datum": "data", "analysis": "analyses", "thesis": "theses",
    "hypothesis": "hypotheses", "crisis": "crises", "cactus": "cacti", "fungus": "fungi", "nucleus": "nuclei", "radius": "radii", "alumnus": "alumni", "stimulus": "stimuli",
    "species": "species", "series": "series", "aircraft": "aircraft", "spacecraft": "spacecraft",
}
#: Words that the graph query language reserves.
KEYWORDS = (
    "ALL AND ANY AS ASC ASCENDING BY CALL CASE CONTAINS COUNT CREATE DELETE DESC DESCENDING DETACH DISTINCT DO DROP ELSE END ENDS EXISTS FALSE FILTER FOREACH IN IS LIMIT MANDATORY MATCH MERGE NODE NONE NOT NULL "
    "OF ON OPTIONAL OR ORDER REDUCE RELATIONSHIP REMOVE RETURN SET SINGLE SKIP SOME STARTS THEN TRUE UNION UNIQUE UNWIND USING WHEN WHERE WITH XOR YIELD"
).split()


def estimate_tokens(text: Column) -> Column:
    """(bytes + white space + ASCII punctuation) / 4, whole."""
    marks = F.regexp_count(text, F.lit(r"(?U)\s")) + F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]"))
    return F.floor((F.octet_length(text) + marks) / 4).cast("bigint")


def estimate_tokens_coarse(text: Column) -> Column:
    """(bytes - white space) / 4 + white space / 3, each whole."""
    blanks = F.regexp_count(text, F.lit(r"(?U)\s"))
    return (F.floor((F.octet_length(text) - blanks) / 4) + F.floor(blanks / 3)).cast("bigint")


def savings_percent(before: Column, after: Column) -> Column:
    """The share saved in percent, rounded half away from zero; zero where there was nothing."""
    return F.when(before == 0, F.lit(0)).otherwise(F.round((before - after) * 100.0 / before)).cast("bigint")


def change_percent(base: Column, current: Column) -> Column:
    return F.when(base == 0, F.lit(0.0)).otherwise((current - base) / base * 100.0)


def singular(word: Column) -> Column:
    stem = F.substr(word, F.lit(1), F.length(word) - 2)
    shorter = F.substr(word, F.lit(1), F.length(word) - 1)
    return (
        F.when(word.endswith("ies") & (F.length(word) > 3), F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(word.endswith("es") & (F.length(word) > 2), F.when(stem.rlike("(ss|sh|ch|x)$"), stem).otherwise(shorter))
        .when(word.endswith("s") & (F.length(word) > 1), shorter)
        .otherwise(word)
    )


def type_name(key: Column) -> Column:
    """The type that a key names: singular, with a capital at the start and after each underscore, which go."""
    parts = F.filter(F.split(singular(key), "_"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))), "")


def plural(word: Column) -> Column:
    return (
        F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .when(word.endswith("y") & ~word.rlike("(ay|ey)$"), F.concat(F.substr(word, F.lit(1), F.length(word) - 1), F.lit("ies")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def plural_irregular(word: Column) -> Column:
    """Plural by a list of irregular forms, else with an s, in the letter case of the word."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair]), F.lower(word))
    all_upper = word == F.upper(word)
    capital = F.substr(word, F.lit(1), F.lit(1)).rlike(r"^\p{Lu}")
    shaped = F.when(all_upper, F.upper(known)).when(capital, F.concat(F.upper(F.substr(known, F.lit(1), F.lit(1))), F.substr(known, F.lit(2)))).otherwise(known)
    return F.when(word == "", word).when(known.isNotNull(), shaped).otherwise(F.concat(word, F.when(all_upper, F.lit("S")).otherwise(F.lit("s"))))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9_]", "_"))


def identifier(name: Column) -> Column:
    """Characters that no identifier has become underscores; a leading digit gets one, and so does nothing at all."""
    safe = F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")
    return F.when(name == "", F.lit("_")).when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe)


def relationship_type(name: Column) -> Column:
    """Words in capitals with single underscores between them."""
    parted = F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2")
    return F.upper(F.regexp_replace(F.regexp_replace(parted, r"[^A-Za-z0-9]+", "_"), "^_|_$", ""))


def escape_string(text: Column) -> Column:
    steps = [("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\u0000")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def quote_string(text: Column) -> Column:
    return F.concat(F.lit("'"), escape_string(text), F.lit("'"))


#: Control characters and format characters that names must not have.
UNSAFE = r"[\x00-\x1f\x7f-\x9f\u00ad\u061c\u180e\u200b-\u200d\u202a-\u202e\u2066-\u2069\ufeff]"


def safe_name(name: Column) -> Column:
    """A name in composed form (NFC) without characters that only confuse readers."""

    @F.pandas_udf("string")
    def composed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.regexp_replace(F.when(name.rlike(r"^[\x00-\x7f]*$"), name).otherwise(composed(name)), UNSAFE, "")


def at_most_bytes(text: Column, most: int) -> Column:
    """The text; an action fails where it has more bytes."""
    return F.when(F.octet_length(text) <= most, text).when(text.isNotNull(), F.raise_error(F.lit(f"text exceeds {most} bytes")).cast("string"))


def is_keyword(word: Column) -> Column:
    return F.upper(word).isin(*KEYWORDS)


def escape_identifier(name: Column) -> Column:
    plain = name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~is_keyword(name)
    return F.when(plain, name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def name_format(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("email"), "email")
        .when(low.contains("url") | low.contains("uri"), "uri")
        .when(low.contains("date") | low.endswith("_at") | low.endswith("_on"), "date-time")
        .when(low.contains("uuid") | low.contains("guid"), "uuid")
    )


def string_format(text: Column, name: Column | None = None) -> Column:
    """email, uri, date-time or uuid by the text, else by the field's name, else null."""
    by_text = (
        F.when(text.contains("@") & text.contains(".") & ~text.startswith("@"), "email")
        .when(text.startswith("http://") | text.startswith("https://") | text.startswith("ftp://"), "uri")
        .when(text.contains("T") & (text.contains("Z") | text.contains("+") | text.contains("-")) & (F.octet_length(text) >= 19), "date-time")
        .when((F.octet_length(text) == 36) & (F.regexp_count(text, F.lit("-")) == 4), "uuid")
    )
    return by_text if name is None else F.coalesce(by_text, name_format(name))


def tensor_shape(data: Column, rank: int) -> Column:
    """Lengths along the first element of each level."""
    out, at = [], data
    for _ in range(rank):
        out.append(F.size(at))
        at = F.get(at, F.lit(0))
    return F.array(*out)


def tensor_flat(data: Column, rank: int) -> Column:
    for _ in range(rank - 1):
        data = F.flatten(data)
    return data


def tensor_is_integer(flat: Column) -> Column:
    return F.forall(flat, lambda x: x == F.floor(x))


# ---- answers in a common form


def clean_answer(text: Column) -> Column:
    """Without a code fence, then without quotes, around it."""

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    s = strip(text)
    s = F.when(s.rlike(r"(?s)^```[^\n]*\n.*```"), strip(F.regexp_extract(s, r"(?s)^```[^\n]*\n(.*)```", 1))).otherwise(s)
    return strip(F.when(s.rlike(r"""(?s)^(".*"|'.*')$"""), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s))


def _bare_number(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9.+eE-]", "")


def normal_integer(text: Column) -> Column:
    """An integer among other marks; a decimal number loses its fraction."""
    bare = _bare_number(text)
    return F.coalesce(bare.try_cast("bigint"), bare.try_cast("double").cast("bigint")).cast("string")


def normal_number(text: Column, decimals: int) -> Column:
    """A number with so many decimals; percentages are shares of one."""
    value = _bare_number(text).try_cast("double")
    value = F.when(text.contains("%"), value / 100).otherwise(value)
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", F.round(value, decimals)))


def normal_boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("yes", "y", "true", "1", "on"), "true").when(low.isin("no", "n", "false", "0", "off"), "false")


def normal_date(text: Column) -> Column:
    """year-month-day, from that order with dashes or from month/day/year."""
    parts = F.split(text, "/")
    return F.when(text.rlike(r"^.{4}-..-.."), F.substr(text, F.lit(1), F.lit(10))).when(text.rlike(r"^../../.{4}"), F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0")))


def normal_list(text: Column, ordered: bool) -> Column:
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return F.array_join(parts if ordered else F.array_sort(parts), ",")
