"""Lines of text to fields: fixed-width rows, labelled numbers, totals, headers, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"\d[\d,]*"


def numbers_in(line: Column) -> Column:
    """All numbers of a line, commas dropped."""
    return F.transform(F.regexp_extract_all(line, F.lit(NUMBER), 0), lambda x: F.regexp_replace(x, ",", "").cast("bigint"))


def fixed_row(line: Column, width: int) -> Column:
    """(code, name, values) of a line that has a code, a name and `width` numbers at its end; else null."""
    pattern = rf"^\s*(\S+)\s+(.*?)((?:\s+{NUMBER}){{{width}}})\s*$"
    tail = F.regexp_extract(line, pattern, 3)
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("code"), F.trim(F.regexp_extract(line, pattern, 2)).alias("name"), numbers_in(tail).alias("values")))


def trailing_number(line: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(line, rf"({NUMBER})\s*$", 1), ",", ""), F.lit("")).cast("bigint")


def labelled_numbers(lines: DataFrame, keys: Sequence[str], order: str, line: str, label: str) -> DataFrame:
    """For lines that contain the label: the number at their end, else at the end of one of the next two lines."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = [trailing_number(F.col(line)), trailing_number(F.lead(line, 1).over(w)), trailing_number(F.lead(line, 2).over(w))]
    return lines.withColumn("number", F.coalesce(*at)).where(F.contains(F.col(line), F.lit(label)))


def after_last(lines: DataFrame, keys: Sequence[str], order: str, line: str, marker: str) -> DataFrame:
    """The numbers, in order, of the lines from the last one with the marker on."""
    last = lines.where(F.contains(F.col(line), F.lit(marker))).groupBy(*keys).agg(F.max(order).alias("_from"))
    found = lines.join(last, list(keys)).where(F.col(order) >= F.col("_from"))
    return found.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), numbers_in(F.col(line)).alias("n")))), lambda x: x["n"])).alias("numbers"))


def best_header(rows: DataFrame, keys: Sequence[str], order: str, cells: str, among: int = 10) -> DataFrame:
    """Of the first rows the one with the most non-empty cells; the earlier on a tie."""
    filled = F.size(F.filter(cells, lambda x: x.isNotNull() & (F.trim(x) != "")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= among)
    return first.groupBy(*keys).agg(F.max_by(F.struct(F.col(order).alias("at"), filled.alias("filled")), F.struct(filled, -F.col("_n"))).alias("h")).select(*keys, "h.at", "h.filled")


def date_in(x: Column) -> Column:
    """yyyymmdd anywhere in a text, as a date."""
    return F.try_to_date(F.nullif(F.regexp_extract(x, r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


#: A word of two or more letters, each printed twice.
DOUBLED = r"(?s)^(?=...)(?:(.)\1)++\z"


def collapse_overlay(x: Column) -> Column:
    """Text printed twice over itself: a repeated half of the lines goes, equal neighbours go, aabbcc becomes abc."""
    lines = F.split(x, "\n", -1)
    half = F.floor(F.size(lines) / 2).cast("int")
    first = F.slice(lines, F.lit(1), half)
    once = F.when((half > 0) & (F.size(lines) % 2 == 0) & (first == F.slice(lines, half + 1, half)), first).otherwise(lines)
    single = lambda w: F.when(w.rlike(DOUBLED), F.regexp_replace(w, r"(?s)(.)\1", "$1")).otherwise(w)
    spelt = lambda line: F.when(line.rlike(r"([^ ])\1([^ ])\2"), F.array_join(F.transform(F.split(line, " ", -1), single), " ")).otherwise(line)
    pairs = F.arrays_zip(once.alias("own"), F.concat(F.array(F.lit(None).cast("string")), once).alias("last"))
    kept = F.filter(pairs, lambda p: p["own"].isNotNull() & ~p["own"].eqNullSafe(p["last"]))
    return F.when(x.isNotNull(), F.array_join(F.transform(kept, lambda p: spelt(p["own"])), "\n"))


def balanced_groups(numbers: Column, width: int, most: int = 2) -> Column:
    """A run of numbers as groups of `width` whose first is the sum of the others.

    Up to `most` stray numbers at either end are left out, as few as possible; null if no grouping balances."""

    def fit(skip: int, drop: int) -> Column:
        count = F.size(numbers) - skip - drop
        groups = F.transform(F.sequence(F.lit(0), (count / width).cast("int") - 1), lambda g: F.slice(numbers, g * width + skip + 1, F.lit(width)))
        balanced = F.forall(groups, lambda g: F.get(g, F.lit(0)) == F.aggregate(F.slice(g, 2, width - 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.when((count >= width) & (count % width == 0), F.when(balanced, groups))

    return F.coalesce(*(fit(a, b) for a, b in sorted(((a, b) for a in range(most + 1) for b in range(most + 1)), key=lambda x: (sum(x), x))))
