"""Operator 3: quality rules by distribution divergence, in DataFrame functions only.

Each document has two histograms: its characters by class, and its words by the commonest words of its language. Both
are compared with the references of that language by Jensen-Shannon distance. A document whose distance exceeds the
limit fails, unless it is shorter than the minimum length for that comparison or its language has no reference. The
base rules (word count, repeated five-word windows) come first.

Defined results: a null or empty text has no words, so it fails the base rule; a null or unknown language is judged by
the base rules alone; repeated rows are judged alike; other columns are not needed and not carried; an empty table
gives an empty table. Equal distances and limits keep the document.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import table

CLASSES = ("lower", "upper", "digit", "space", "other_letter", "symbol", "punctuation")

# For each language the shares of CLASSES in running prose, then its commonest words with their shares
# of all words.
REFERENCES: dict[str, tuple[tuple[float, ...], dict[str, float]]] = {
    "en": ((0.80, 0.02, 0.005, 0.155, 0.0, 0.0, 0.02), {"the": 0.060, "of": 0.035, "and": 0.027, "to": 0.024, "in": 0.020, "a": 0.020, "is": 0.012, "that": 0.011}),
    "fr": ((0.74, 0.02, 0.005, 0.16, 0.055, 0.0, 0.02), {"de": 0.050, "la": 0.030, "le": 0.022, "et": 0.020, "les": 0.018, "des": 0.017, "en": 0.014, "que": 0.012}),
    "de": ((0.78, 0.04, 0.005, 0.14, 0.015, 0.0, 0.02), {"der": 0.034, "die": 0.032, "und": 0.026, "in": 0.018, "den": 0.013, "von": 0.010, "zu": 0.011, "das": 0.010}),
    "es": ((0.77, 0.02, 0.005, 0.16, 0.025, 0.0, 0.02), {"de": 0.060, "la": 0.037, "que": 0.028, "el": 0.028, "en": 0.025, "y": 0.024, "los": 0.016, "a": 0.018}),
}
MAX_CHARACTER_DISTANCE = 0.30
#: Between the largest word distance of labelled clean text (sf0.1: en 0.252, fr 0.270, de 0.221, es 0.269) and that of
#: a text without any common word (0.337, 0.313, 0.286, 0.360).
WORD_LIMITS = {"en": 0.285, "fr": 0.29, "de": 0.25, "es": 0.305}
MIN_CHARACTERS, MIN_WORDS = 200, 50

_SPACES = " \t\n\x0b\f\r"
#: A common word counts whatever its case, with or without these at its edges.
_UPPER, _EDGES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?()[]\"'-"
_WS = r"[\x20\x09-\x0D]+"


def _by_language(lang: Column, values: dict[str, Column], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, value in values.items():
        out = F.when(lang == name, value.cast(kind)).otherwise(out)
    return out


def _distance(counts: list[Column], total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of counts against an array of shares."""
    terms = []
    for k, count in enumerate(counts):
        p, q = count / total, reference[k]
        m = (p + q) / 2
        terms.append(F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0))
    return F.sqrt(F.greatest(reduce(add, terms) / 2, F.lit(0.0)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", references: dict[str, tuple[tuple[float, ...], dict[str, float]]] = REFERENCES, carry: bool = False, limits: dict[str, float] = WORD_LIMITS) -> DataFrame:
    """One row per document: base counts and both distances (null where a guard or a missing reference applies),
    and the language's limit of the word distance.

    With carry, the k-th input column comes along as `in_k`, so that its name can't clash.
    """
    text, lang = F.col("text"), F.col("lang")
    rest = [f"in_{k}" for k in range(len(docs.columns) if carry else 0)]
    df = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, rest, strict=False)), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    df = df.select(
        *rest, "id", "lang", F.length(text).alias("chars"),
        F.when(F.btrim(text, F.lit(_SPACES)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(_SPACES)), _WS)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace(text, "[a-z]+", "").alias("rest"),
    )
    df = df.select("*", F.regexp_replace("rest", _WS, "").alias("odd"), F.size("words").alias("n"))
    window = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(5)))
    common = _by_language(lang, {name: F.array(*map(F.lit, words)) for name, (_, words) in references.items()}, "array<string>")
    bare = F.transform("words", lambda w: F.btrim(F.translate(w, _UPPER, _UPPER.lower()), F.lit(_EDGES)))
    df = df.select(
        *rest, "id", "lang", "chars", "n",
        (F.length("rest") - F.length("odd")).alias("space"),
        (F.col("chars") - F.length("rest")).alias("lower"),
        F.length("odd").alias("odd_chars"),
        *((F.length("odd") - F.length(F.regexp_replace("odd", pattern, ""))).alias(name) for name, pattern in (("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", r"[#*$%&|<>]+"), ("other_letter", r"[^\x00-\x7F]+"))),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup_lines"),
        F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(0), F.col("n") - 5), window)).alias("windows"),
        F.transform(F.filter(bare, lambda w: F.array_contains(common, w)), lambda w: F.array_position(common, w)).alias("hits"),
    )
    # A window that equals its neighbour in hash order is repeated; its words are the union of five-word spans.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("windows", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("windows", lambda x, k: (x["h"] == F.get("windows", k + 1)["h"]) | (x["h"] == F.get("windows", k - 1)["h"]))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    step = F.transform("at", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("at", k + 1) - x, F.lit(5))))
    df = df.withColumn("repeated", F.coalesce(F.aggregate(step, F.lit(0), lambda a, b: a + b), F.lit(0)))
    classes = [F.col("lower"), F.col("upper"), F.col("digit"), F.col("space"), F.col("other_letter"), F.col("symbol"), F.col("odd_chars") - F.col("upper") - F.col("digit") - F.col("symbol") - F.col("other_letter")]
    places = max(len(words) for _, words in references.values())
    at = lambda k: F.size(F.filter("hits", lambda x: x == k + 1))
    found = [at(k) for k in range(places)]
    char_ref = _by_language(lang, {name: F.array(*(F.lit(x / sum(shares)) for x in shares)) for name, (shares, _) in references.items()}, "array<double>")
    padded = {name: [*words.values(), *[0.0] * (places - len(words)), 1 - sum(words.values())] for name, (_, words) in references.items()}
    word_ref = _by_language(lang, {name: F.array(*map(F.lit, x)) for name, x in padded.items()}, "array<double>")
    df = df.select("*", char_ref.alias("char_ref"), word_ref.alias("word_ref"), *(x.alias(f"f{k}") for k, x in enumerate(found)))
    counts = [F.col(f"f{k}") for k in range(places)]
    return df.select(
        *rest,
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        (F.col("chars") - F.col("space")).cast("long").alias("word_chars"),
        F.col("symbol").cast("long").alias("n_symbols"),
        F.col("dup_lines").cast("long").alias("n_dup_lines"),
        F.col("repeated").cast("long").alias("n_repeat_words"),
        F.when((F.col("chars") >= MIN_CHARACTERS) & F.col("char_ref").isNotNull(), _distance(classes, F.col("chars"), F.col("char_ref"))).alias("character_distance"),
        F.when((F.col("n") >= MIN_WORDS) & F.col("word_ref").isNotNull(), _distance([*counts, F.col("n") - reduce(add, counts)], F.col("n"), F.col("word_ref"))).alias("word_distance"),
        _by_language(lang, {name: F.lit(x) for name, x in limits.items()}, "double").alias("word_limit"),
    )


def judge(measured: DataFrame, max_character: float = MAX_CHARACTER_DISTANCE) -> DataFrame:
    """base_failed and kept for measured documents."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.coalesce("character_distance", F.lit(0.0)) > max_character) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The input rows that are kept, with all their columns."""
    judged = judge(measure(docs, id_col, text_col, lang_col, carry=True)).withColumn("row", F.monotonically_increasing_id())
    # A filter isn't moved below a column that counts rows; moved, it would repeat all expressions above in itself.
    return judged.where(F.col("kept") & (F.col("row") >= 0)).select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(measure(table(spark, sf_dir, "documents"))).drop("character_distance", "word_distance", "word_limit")


QUERIES = {"op3_quality_rules": op3_quality_rules}


def _oracle() -> str:
    """The same rules as SQL: counts of characters by stripping, windows by a join of positions."""
    stripped = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"
    patterns = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "space": r"[\x20\x09-\x0D]+", "other_letter": r"[^\x00-\x7F]+", "symbol": "[#*$%&|<>]+"}
    counts = ", ".join(f"{stripped(p)} AS c_{name}" for name, p in patterns.items())
    parts = [f"c_{name}" for name in CLASSES[:-1]] + ["chars - c_lower - c_upper - c_digit - c_space - c_other_letter - c_symbol"]

    def distance(values: list[str], total: str, shares: list[float]) -> str:
        term = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END"
        sums = []
        for value, q in zip(values, shares, strict=True):
            p = f"(({value}) / {total})"
            sums += [term(p, f"({p} + {q}) / 2"), term(f"CAST({q} AS DOUBLE)", f"({p} + {q}) / 2")]
        return f"sqrt(greatest(({' + '.join(sums)}) / 2, 0))"

    far_c, far_w, limit = "CASE lang", "CASE lang", "CASE lang"
    for lang, (shares, common) in REFERENCES.items():
        far_c += f" WHEN '{lang}' THEN {distance(parts, 'chars', [x / sum(shares) for x in shares])}"
        hits = [f"h{k}" for k in range(len(common))]
        far_w += f" WHEN '{lang}' THEN {distance([*hits, 'n - ' + ' - '.join(hits)], 'n', [*common.values(), 1 - sum(common.values())])}"
        limit += f" WHEN '{lang}' THEN {WORD_LIMITS[lang]}"
    refs = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {list(common)}" for lang, (_, common) in REFERENCES.items()) + " END"
    places, edges = max(len(common) for _, common in REFERENCES.values()), _EDGES.replace("'", "''")
    found = ", ".join(f"len(list_filter(bare, lambda x: x = ref[{k + 1}])) AS h{k}" for k in range(places))
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS times FROM (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS key FROM d)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM win, range(5) r(k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT doc_id, lang, {found}, len(ws) AS n, length(text) AS chars, coalesce(dups, 0) AS dups, coalesce(repeated, 0) AS repeated, {counts} FROM (SELECT *, {refs} AS ref, list_transform(ws, lambda w: trim(translate(w, '{_UPPER}', '{_UPPER.lower()}'), '{edges}')) AS bare FROM d) LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, CASE WHEN chars >= {MIN_CHARACTERS} THEN {far_c} END END AS far_c, CASE WHEN n >= {MIN_WORDS} THEN {far_w} END END AS far_w, n < 10 OR 100 * repeated > 20 * n AS failed FROM m)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars - c_space AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, CAST(repeated AS BIGINT) AS n_repeat_words, failed AS base_failed, NOT failed AND coalesce(far_c, 0) <= {MAX_CHARACTER_DISTANCE} AND coalesce(far_w <= {limit} END, TRUE) AS kept FROM j"""


ORACLES = {"op3_quality_rules": _oracle()}
