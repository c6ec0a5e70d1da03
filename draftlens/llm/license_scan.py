"""License scans with a positional index of rare words, in Spark expressions only.

A template is a run of licence words; its key phrase is what makes a place of it.
Document frequencies of all template words are counted over the corpus. Of each key
phrase the two words with the highest IDF are indexed with their offsets, so every
place of it holds both. In a file the indexed words are looked up; each occurrence
names the start its template would have, and the starts of both words are intersected.
At the starts left the key phrase is verified word for word, the rest of the template
is scored by IDF, and the template's mandatory phrases decide its label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words: ASCII other than letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wordings of common licences. (label, template, key phrase, further mandatory phrases.)
TEMPLATES = (
    ("mit-notice", "released under the mit license", "mit license", ("under the mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge", ()),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license", ("apache license version 2 0",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license", ()),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms", ()),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software", ()),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", ("public domain",)),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0", ()),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0", ()),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0", ()),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", ()),
)
#: Share of a template's IDF that its label needs.
SHARE = 0.8


def offset(words: list[str], phrase: str) -> int:
    part = phrase.split()
    return next(i for i in range(len(words)) if words[i:i + len(part)] == part)


def all_templates(templates=TEMPLATES, base=BASE) -> list[tuple]:
    """(is_base, label, words, offset of the key phrase, key words, [(offset, words) that are mandatory])."""
    out = [(True, label, p.split(), 0, p.split(), []) for p, label in base]
    for label, text, key, more in templates:
        words = text.split()
        out.append((False, label, words, offset(words, key), key.split(), [(offset(words, p), p.split()) for p in more]))
    return out


def words_of(text) -> Column:
    """Words of a text with A-Z in lower case; null has none.

    Full lower case gives the same template words, but for two letters that become ASCII.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("\u212A")) | F.contains(text, F.lit("\u0130"))
    low = F.when(odd, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, GAPS), "")


def weight(n_docs: int, df: int) -> int:
    """IDF of a word in 1/1024, one at least, so that sums are exact."""
    return 1024 + math.floor(1024 * math.log((n_docs + 1) / (df + 1)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE, share: float = SHARE) -> DataFrame:
    """Places of licence templates in each document.

    One row per input row: doc_id, n_words, places (start of the key phrase, base,
    label, score, whole: the label holds). ``score`` is the share of the template's
    IDF whose words stand where the template has them; a base phrase has none.
    A label of a template that is not a base phrase holds if its mandatory phrases
    stand there too and the score reaches ``share``. Null and empty texts have no
    words; texts of any length are read whole, as one value of one row. Repeated rows
    are judged alike, each on its own; ids may be null. Other columns are ignored.
    The corpus statistics are one count for each template word.
    """
    known = all_templates(templates, base)
    vocabulary = sorted({w for t in known for w in t[2]})
    rows = docs.select(docs[id_col].alias("doc_id"), words_of(docs[text_col]).alias("words"))
    rows = rows.withColumn("found", F.array_intersect("words", F.array(*map(F.lit, vocabulary))))
    # One row per template word at most, and one with the number of documents.
    counts = rows.select(F.explode(F.array_append("found", F.lit(""))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in counts}
    idf = {w: weight(df.get("", 0), df.get(w, 0)) for w in vocabulary}

    items, indexed = [], set()
    for is_base, label, words, at, key, more in known:
        rare = sorted(range(at, at + len(key)), key=lambda i: (-idf[words[i]], i))[:2]
        first, second = rare[0], rare[-1]
        indexed |= {words[first], words[second]}
        texts = lambda ws: F.array(*map(F.lit, ws))
        must = [F.struct(F.lit(i).alias("at"), texts(p).alias("words")) for i, p in [(at, key), *more]]
        items.append(F.struct(
            F.lit(is_base).alias("base"), F.lit(label).alias("label"), texts(words).alias("words"), F.lit(at).alias("at"),
            texts(key).alias("key"), F.array(*must).alias("must"),
            F.array(*[F.lit(idf[w]) for w in words]).alias("idf"), F.lit(sum(idf[w] for w in words)).alias("total"),
            F.lit(words[first]).alias("w1"), F.lit(first).alias("o1"), F.lit(words[second]).alias("w2"), F.lit(second).alias("o2")))
    index = F.array(*items)
    lookups = sorted(indexed)

    stands = lambda start, phrase: (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size(phrase)) == phrase)
    hit = lambda w, i: F.when(w.isin(lookups), F.struct(w.alias("w"), i.alias("i")))
    starts = lambda w, o: F.transform(F.filter("hits", lambda h: h["w"] == w), lambda h: h["i"] - o)

    def place(t, s):
        aligned = F.aggregate(F.transform(t["words"], lambda w, j: F.when(F.get("words", s + j) == w, F.get(t["idf"], j)).otherwise(0)),
                              F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
        score = aligned.cast("double") / t["total"]
        holds = t["base"] | ((score >= share) & F.forall(t["must"], lambda m: stands(s + m["at"], m["words"])))
        return F.struct((s + t["at"]).cast("long").alias("start"), t["base"].alias("base"), t["label"].alias("label"),
                        F.when(~t["base"], score).alias("score"), holds.alias("whole"))

    def postings(t):
        both = F.array_intersect(starts(t["w1"], t["o1"]), starts(t["w2"], t["o2"]))
        return F.transform(F.filter(both, lambda s: stands(s + t["at"], t["key"])), lambda s: place(t, s))

    named = F.filter(index, lambda t: F.array_contains("found", t["w1"]) & F.array_contains("found", t["w2"]))
    rows = rows.withColumn("asked", F.arrays_overlap("found", F.array(*map(F.lit, lookups))))
    none = F.array().cast("array<struct<w:string,i:int>>")
    rows = rows.withColumn("hits", F.when(F.col("asked"), F.array_compact(F.transform("words", hit))).otherwise(none))
    rows = rows.withColumn("places", F.flatten(F.transform(named, postings)))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "places")
