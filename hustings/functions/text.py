"""The normalising and slug families, and parsing of codes. Variants differ on purpose; each has its own name."""

from __future__ import annotations

import difflib
import functools
import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Combining marks that are dropped, and precomposed Hangul, whose parts are found by arithmetic.
MARKS, HANGUL = "[\\u0300-\\u036F]", "[\\uAC00-\\uD7A3]"
_LAST = 0x30000
#: What parts words once a text is lower-case ASCII.
_BETWEEN = "".join(c for c in map(chr, range(0x80)) if not c.isalnum())


def _ascii(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


def _unmarked(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")


@functools.cache
def _tables(rule: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """The characters beyond ASCII that a rule turns into one other, these others, and what it turns into several."""
    turned = {c: rule(c) for c in map(chr, range(0x80, _LAST)) if not "\ud800" <= c <= "\udfff" and not "\uac00" <= c <= "\ud7a3"}
    one = {c: t for c, t in turned.items() if len(t) == 1 and t != c}
    return "".join(one), "".join(one.values()), {c: t for c, t in turned.items() if len(t) > 1}


def _folded(x: Column, rule: Callable[[str], str], dropped: str, hangul: bool = False) -> Column:
    """Each character by the rule, then without the dropped ones, all in the JVM. ASCII stays as it is; only texts with
    characters that become several are cut into runs of ASCII and single characters. Which they are is looked up in a
    table: a class of hundreds of characters would be tried one by one at every letter. ASCII is told by counting
    bytes: a pattern for it made another one in the same task three times slower (9 and 27 task s over 0.1 GB)."""
    keys, values, several = _tables(rule)
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # a constant when the plan is made
    listed = "".join(several)
    found = F.translate(x, listed, "") != x
    other = lambda c: F.when(F.ascii(c) < 128, c).when(F.translate(c, listed, "") == "", F.try_element_at(table, c))
    whole = other
    if hangul:
        found = found | x.rlike(HANGUL)
        whole = lambda c: other(c).when(F.ascii(c).between(0xAC00, 0xD7A3), _jamo(c))
    pieces = F.regexp_extract_all(x, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    spread = F.when(found, F.array_join(F.transform(pieces, lambda c: whole(c).otherwise(c)), "")).otherwise(x)
    plain = (F.octet_length(x) == F.char_length(x)) & F.is_valid_utf8(x)
    return F.when(x.isNull() | plain, x).otherwise(F.regexp_replace(F.translate(spread, keys, values), dropped, ""))


def fold_ascii(x: Column) -> Column:
    """Compatibility decomposition, then ASCII alone."""
    return _folded(x, _ascii, "[^\\x00-\\x7F]+")


def _jamo(c: Column) -> Column:
    """A Hangul syllable as its two or three letters."""
    k = F.ascii(c) - 0xAC00
    pick = lambda first, n, at: F.substring(F.lit("".join(chr(first + i) for i in range(n))), at.cast("int") + 1, F.lit(1))
    return F.concat(pick(0x1100, 19, F.floor(k / 588)), pick(0x1161, 21, F.floor(k % 588 / 28)), F.when(k % 28 > 0, pick(0x11A7, 28, k % 28)).otherwise(""))


def strip_marks(x: Column) -> Column:
    """Canonical decomposition without combining marks U+0300 to U+036F; other scripts stay. Several other marks in a row
    keep the order in which they stand."""
    return _folded(x, _unmarked, MARKS, hangul=True)


def _compared(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


#: Pairs of short texts come again and again, as names do; a task keeps so many of the last ones.
_kept = functools.lru_cache(1 << 16)(_compared)
SHORT = 256


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two texts."""
    return _kept(a, b) if len(a) + len(b) <= SHORT else _compared(a, b)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def lower_with_spaces(x: Column) -> Column:
    """The words, from which the other four are made by plain replacing: side by side they are folded once."""
    spaced = F.translate(F.lower(fold_ascii(x)), _BETWEEN, " " * len(_BETWEEN))
    for old, new in ((" ", "<>"), ("><", ""), ("<>", " ")):  # runs of spaces become one
        spaced = F.replace(spaced, F.lit(old), F.lit(new))
    return F.trim(spaced)


def upper_with_spaces(x: Column) -> Column:
    return F.upper(lower_with_spaces(x))


def lower_no_spaces(x: Column) -> Column:
    return F.replace(lower_with_spaces(x), F.lit(" "), F.lit(""))


def upper_no_spaces(x: Column) -> Column:
    return F.upper(lower_no_spaces(x))


def lower_marks(x: Column) -> Column:
    """Marks stripped and lower-cased; punctuation and other scripts stay."""
    return F.lower(strip_marks(x))


def canonical_name(x: Column) -> Column:
    """Upper-cased, other than A-Z and 0-9 to spaces; accents aren't folded."""
    return F.trim(F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9]+", " "))


def slug(x: Column) -> Column:
    return F.replace(lower_with_spaces(x), F.lit(" "), F.lit("-"))


def slug_territory(x: Column) -> Column:
    """As slug, with W.P written WP first."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lower_marks(x), r"w\.p", "wp"), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def state_id(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"w\.p", "wp"), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def catalogue_id(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def short_name(x: Column) -> Column:
    """What stands in parentheses at the end, else the whole."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"\(([^()]+)\)\s*$", 1), F.lit("")), x)


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clean_text(x: Column, length: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(x, r"[\x00-\x1F\x7F]+", " ")), 1, length)


def clean_path(x: Column, length: int = 180) -> Column:
    """Path without query and fragment; / where there is none."""
    return F.substring(F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(x, r"^[a-z]+://[^/]*", ""), r"^[^?#]*", 0), F.lit("")), F.lit("/")), 1, length)


def hue(x: Column) -> Column:
    """A colour's hue from a name: a rolling hash of its characters modulo 360."""
    return F.aggregate(F.split(x, ""), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)), lambda h: h % 360)


def code(x: Column) -> Column:
    """P.ddd at the start; null without."""
    return F.nullif(F.regexp_extract(x, r"^(P\.\d{3})", 1), F.lit(""))


def code_number(x: Column) -> Column:
    """The number of a code, by which codes are sorted."""
    return F.nullif(F.regexp_extract(x, r"\.(\d+)", 1), F.lit("")).cast("int")


def without_code(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"^[A-Z]\.\d+\s*", ""))


def padded_code(number: Column) -> Column:
    return F.concat(F.lit("N."), F.lpad(number.cast("string"), 2, "0"))


def cells(html: Column) -> Column:
    """Map of the pairs of table cells <td>key</td><td>value</td>, tags stripped."""
    strip = lambda t: F.trim(F.regexp_replace(t, r"<[^>]+>", ""))
    pattern = r"(?is)<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("v"))
    distinct = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: strip(q["k"]) == strip(p["k"])))
    return F.map_from_entries(F.transform(distinct, lambda p: F.struct(strip(p["k"]), strip(p["v"]))))
