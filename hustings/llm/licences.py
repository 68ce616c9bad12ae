"""Operator 9: licence scan by a positional rare-token index, in DataFrame functions only.

The postings hold every rare word of every notice template with its place. A template is looked up by its words of
highest IDF: so many that the others together weigh at most 1 - LEAST_SCORE of it, so any alignment that reaches the
least score holds one of them, and none is lost. A looked-up word of a file and a template's posting give an alignment
when place minus posting is the same. Only files with an alignment have all their licence words looked at: the weight
matched at the alignment, over the template's weight, is the score; a template counts if the score reaches the least and
its mandatory key phrase stands there word by word. Files with equal licence words at equal places are looked up once.

Defined results: a null or empty text has no words and no labels; repeated rows are labelled alike; other columns are
not carried; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.llm.common import cut, table

# Phrases and their labels, and notices, licence texts and identifier lines with their labels and mandatory key phrases.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["permission notice shall be included"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["lesser general public license"]),
    *((label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for label, name in [("mit", "mit"), ("apache", "apache 2 0"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("bsd", "bsd"), ("mpl", "mpl 2 0"), ("isc", "isc"), ("cc-by-nc", "cc by nc"), ("cc-by-sa", "cc by sa"), ("unlicense", "unlicense")]),
]
#: Words so common in prose that they never start a lookup; they still count for key phrases.
COMMON = "a above all an and any are as at be but by can do for free from in is it its kind may no not of or other out so that the this to use under whether whom with without you work version 0 2 4".split()
LEAST_SCORE = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _places(words: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively."""
    first, *rest = phrase.split(" ")
    at = lambda w, i: reduce(lambda a, b: a & b, [F.coalesce(F.get("words", i + k + 1) == x, F.lit(False)) for k, x in enumerate(rest)], w == first)
    return F.filter(F.transform(words, lambda w, i: F.when(at(w, i), i)), lambda i: i.isNotNull())


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places by label, hits): the base phrases' places, and the licence words with theirs."""
    vocabulary = sorted({w for _, notice, _ in NOTICES for w in notice.split(" ")} - set(COMMON))
    every = sorted({*vocabulary, *(w for _, _, keys in NOTICES for phrase in keys for w in phrase.split(" "))})
    df = docs.select(F.col(id_col).alias("id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("text"))
    df = df.select("id", F.contains("text", F.lit("license")).alias("named"), F.filter(F.split("text", SEPARATOR), lambda w: w != "").alias("words"))
    none = F.array().cast("array<int>")
    marks = F.transform("words", lambda w, i: F.when(w.isin(every), F.struct(w.alias("w"), i.alias("i"))))
    return df.select(
        "id", F.size("words").alias("n_words"),
        *(F.when(F.col("named"), _places(F.col("words"), phrase)).otherwise(none).alias(label) for phrase, label in PHRASES.items()),
        F.when(F.exists("words", lambda w: w.isin(vocabulary)), F.filter(marks, lambda x: x.isNotNull())).alias("hits"),
    )


def postings(spark: SparkSession) -> DataFrame:
    """(notice, label, word, posting, key): one row per word of a notice; key numbers its key phrase, else null."""
    rows = []
    for notice, (label, text, keys) in enumerate(NOTICES):
        words = text.split(" ")
        inside = {}
        for number, phrase in enumerate(keys):
            parts = phrase.split(" ")
            start = next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)
            inside |= dict.fromkeys(range(start, start + len(parts)), number)
        rows += [f"({notice}, '{label}', '{w}', {i}, {inside.get(i, 'CAST(NULL AS INT)')}, {w not in COMMON})" for i, w in enumerate(words)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS p (notice, label, word, posting, key, rare)")


def lookups(index: DataFrame) -> DataFrame:
    """Postings of highest IDF of each notice, as many as it takes for the rest to weigh too little for the least score.

    index has notice, word, posting, idf and the notice's weight."""
    before = Window.partitionBy("notice").orderBy(F.desc("idf"), "word", "posting").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("idf").over(before), F.lit(0.0))
    # The score is rounded to six digits before it is compared.
    return index.withColumn("ahead", ahead).where(F.col("ahead") <= (1 - LEAST_SCORE + 1e-5) * F.col("weight")).select("notice", "word", "posting")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: n_words, places of each base label, notices found (labels) and the best score."""
    spark = docs.sparkSession
    files = cut(read(docs, id_col, text_col).withColumn("same", F.when(F.size("hits") > 0, F.md5(F.to_json("hits")))))
    total = files.count()
    some = files.where("same is not null")
    rare = postings(spark).where("rare")
    frequency = some.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # As many rows as the templates have words.
    idf = rare.select("word").distinct().join(frequency, "word", "left").select("word", F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 0.5)).alias("idf"))
    weighted = rare.join(idf, "word").withColumn("weight", F.sum("idf").over(Window.partitionBy("notice")))
    index = cut(weighted.select("notice", "word", "posting", "idf", "weight"))
    place = lambda df: df.select("same", F.explode("hits").alias("hit")).select("same", F.col("hit.w").alias("word"), F.col("hit.i").alias("place"))
    aligned = ["same", "notice", "shift"]
    candidates = cut(place(some).join(F.broadcast(lookups(index)), "word").select("same", "notice", (F.col("place") - F.col("posting")).alias("shift")).distinct())
    looked_at = some.select("same", "hits").join(candidates.select("same").distinct(), "same", "left_semi").dropDuplicates(["same"])
    words = cut(place(looked_at))
    met = words.join(F.broadcast(index), "word").groupBy("same", "notice", (F.col("place") - F.col("posting")).alias("shift")).agg((F.sum("idf") / F.first("weight")).alias("share"))
    scored = met.join(candidates, aligned, "left_semi").select(*aligned, F.round(F.least("share", F.lit(1.0)), 6).alias("score")).where(F.col("score") >= LEAST_SCORE)
    keys = postings(spark).where("key is not null")
    lengths = F.broadcast(keys.groupBy("notice", "key").agg(F.count("*").alias("length")))
    verified = (
        scored.join(F.broadcast(keys), "notice").withColumn("place", F.col("shift") + F.col("posting")).join(words, ["same", "word", "place"])
        .groupBy(*aligned, "label", "score", "key").agg(F.count("*").alias("stand")).join(lengths, ["notice", "key"]).where("stand = length")
    )
    notices = verified.groupBy("same").agg(F.collect_set("label").alias("noticed"), F.max("score").alias("score"))
    none = F.array().cast("array<string>")
    plain = files.where("same is null").withColumns({"noticed": none, "score": F.lit(0.0)})
    looked = some.join(notices, "same", "left").withColumns({"noticed": F.coalesce("noticed", none), "score": F.coalesce("score", F.lit(0.0))})
    return plain.unionByName(looked).drop("same", "hits")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    labels = list(PHRASES.values())
    places = F.concat(*labels)
    base = F.array_compact(F.array(*(F.when(F.size(x) > 0, F.lit(x)) for x in labels)))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_union(base, "noticed"))).alias("labels"), "score",
    )


QUERIES = {"op9_licence_scan": op9_licence_scan}


def _oracle() -> str:
    rows = []
    for notice, (label, text, keys) in enumerate(NOTICES):
        words = text.split(" ")
        for phrase in keys:
            start = next(i for i in range(len(words)) if words[i : i + len(phrase.split(" "))] == phrase.split(" "))
        rows += [f"({notice}, '{label}', '{w}', {i}, {str(w not in COMMON).upper()}, {str(start <= i < start + len(keys[0].split(' '))).upper()})" for i, w in enumerate(words)]
    chain = {label: phrase.split(" ") for phrase, label in PHRASES.items()}
    base = " UNION ALL ".join(f"SELECT a.doc_id, a.i, '{label}' AS label FROM tok a " + " ".join(f"JOIN tok t{k} ON t{k}.doc_id = a.doc_id AND t{k}.i = a.i + {k} AND t{k}.w = '{w}'" for k, w in enumerate(ws) if k) + f" WHERE a.w = '{ws[0]}'" for label, ws in chain.items())
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
post (notice, label, w, posting, rare, key) AS (VALUES {', '.join(rows)}),
tok AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) WHERE w IN (SELECT w FROM post)),
base AS ({base}),
found AS (SELECT DISTINCT doc_id, w FROM tok WHERE w IN (SELECT w FROM post WHERE rare)),
idf AS (SELECT w, ln(((SELECT count(*) FROM documents) + 1.0) / (coalesce(df, 0) + 0.5)) AS idf FROM (SELECT DISTINCT w FROM post WHERE rare) LEFT JOIN (SELECT w, count(*) AS df FROM found GROUP BY w) USING (w)),
weight AS (SELECT notice, sum(idf) AS weight FROM post JOIN idf USING (w) WHERE rare GROUP BY notice),
met AS (SELECT doc_id, notice, i - posting AS shift, sum(idf) AS matched FROM tok JOIN idf USING (w) JOIN (SELECT * FROM post WHERE rare) USING (w) GROUP BY ALL),
scored AS (SELECT doc_id, notice, shift, round(least(matched / weight, 1.0), 6) AS score FROM met JOIN weight USING (notice)),
noticed AS (SELECT doc_id, label, max(score) AS score FROM (SELECT s.doc_id, s.notice, p.label, s.shift, s.score, count(*) AS stand FROM scored s JOIN post p ON p.notice = s.notice AND p.key JOIN tok t ON t.doc_id = s.doc_id AND t.i = s.shift + p.posting AND t.w = p.w WHERE score >= {LEAST_SCORE} GROUP BY ALL) v JOIN (SELECT notice, count(*) AS length FROM post WHERE key GROUP BY notice) l ON l.notice = v.notice AND l.length = v.stand GROUP BY doc_id, label),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM noticed) GROUP BY doc_id),
s AS (SELECT doc_id, max(score) AS score FROM noticed GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


ORACLES = {"op9_licence_scan": _oracle()}
