"""License scans with a positional rare-token index, in DataFrame operations only.

Base: places where the words of fixed phrases stand consecutively.

Index: a template's words of highest IDF have postings (template, position), the IDF coming from counts over
all files; so many words that those left out cannot reach the required share without one of them. A file looks
up every index word that it holds. Words that belong to one copy of a template agree in file position minus
template position, which gives candidate offsets; at each, the share counts all words of the template. A
template with enough of its IDF weight at one offset is labelled once its mandatory key phrase is found in the
file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_rows, let, row_key

#: What stands between words; words are the stretches of all other characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, mandatory key phrase, notice text (fixed values).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license", "released under the mit license"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license version"),
    ("agpl-3", "gnu affero general public license", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
]


def license_words(text: Column) -> Column:
    """Lower-cased words; the phrases hold only letters that no other character lower-cases to."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many words license_words gives: the pieces between separators, but for an empty first and last one."""

    def count(body: Column) -> Column:
        ends = sum(F.rlike(F.substring(body, at, 1), F.lit(BETWEEN)).cast("int") for at in (1, -1))
        return F.when(body == "", 0).otherwise(F.size(F.split(body, BETWEEN)) - ends).cast("long")

    return let(F.lower(F.coalesce(text, F.lit(""))), count)


def may_hold_license(text: Column) -> Column:
    """True for all files that hold a phrase or a template's key phrase, without one of which no label is given.

    Each is searched for only where its longest word stands.
    """
    keys = sorted({*PHRASES, *(key for _, key, _ in TEMPLATES)})
    gates = {k: max(k.split(), key=len) for k in keys}

    def found(low: Column) -> Column:
        def held(gate: str) -> Column:
            own = "|".join(BETWEEN.join(k.split()) for k in keys if gates[k] == gate)
            return F.contains(low, F.lit(gate)) & F.rlike(low, F.lit(own))

        return reduce(lambda a, b: a | b, map(held, sorted(set(gates.values()))))

    return F.coalesce(let(F.lower(text), found), F.lit(False))


def places(words: Column, phrase: str) -> Column:
    """Positions, from 0, where the words of a phrase stand consecutively."""
    p = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(p))
    found = F.filter(at, lambda i: reduce(lambda a, b: a & b, (words[i + j] == w for j, w in enumerate(p))))
    loose = F.arrays_overlap(words, F.array(F.lit(p[-1]))) & F.arrays_overlap(words, F.array(F.lit(p[0])))
    return F.when((F.size(words) >= len(p)) & loose, found).otherwise(F.array().cast("array<int>"))


def word_idf(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """IDF of the template words over all files. The vocabulary is fixed, so the counts that reach the driver are, too."""
    import math

    held = F.array_intersect(license_words(F.col(text)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode_outer(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in counts}
    n = df.get("", 0)
    return {w: math.log(1 + (1 + n) / (1 + df.get(w, 0))) for w in vocabulary}  # above 0, also for a word of every file


def index_words(words: list[str], idf: dict[str, float], agree: float) -> list[str]:
    """The words of highest IDF, one at least, without any of which the others weigh less than the required share."""
    ranked = sorted(words, key=lambda w: (-idf[w], w))
    least = agree * sum(idf[w] for w in words) * (1 - 1e-9)
    rest = 0.0
    while len(ranked) > 1 and rest + idf[ranked[-1]] < least:
        rest += idf[ranked.pop()]
    return ranked


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id", agree: float = 0.6) -> DataFrame:
    """Every row of docs with its licence places and labels.

    Adds ``n_words, base_places array<struct<word, label>>, labels array<string>, matches
    array<struct<label, word, score>>, score``. ``agree`` is the share of the IDF of all words of a template that
    must agree at one offset. A null text counts as empty; a file without any licence word has no match and score 0. Rows that repeat get equal results.
    A column of docs that has the name of an added one is replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "base_places", "matches", "labels", "score")]
    # own columns stand apart from those of docs, whatever their names are
    docs = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    id_col, text = "_id", "_text"
    vocabulary = sorted({w for _, _, t in TEMPLATES for w in t.split()})
    idf = word_idf(docs, vocabulary, text)
    bodies = [list(dict.fromkeys(body.split())) for _, _, body in TEMPLATES]
    postings = [(w, t, words.index(w)) for t, words in enumerate(body.split() for _, _, body in TEMPLATES) for w in index_words(bodies[t], idf, agree)]
    index = spark.createDataFrame(postings, "word string, tid int, tpos int")
    looked_up = F.array(*(F.lit(w) for w in sorted({w for w, _, _ in postings})))

    def placed_words(words: Column) -> Column:
        """The places of all index words of a file."""
        return F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.array_contains(looked_up, x["word"]))

    def share(words: Column, tid: Column, off: Column) -> Column:
        """The share of a template's IDF whose words stand at their places from an offset on."""

        def of(t: int) -> Column:
            own = [(w, TEMPLATES[t][2].split().index(w)) for w in bodies[t]]
            held = sum((F.when(F.get(words, off + at) == w, idf[w]).otherwise(0.0) for w, at in own), F.lit(0.0))
            return F.least(held / sum(idf[w] for w in bodies[t]), F.lit(1.0))

        return reduce(lambda other, t: F.when(tid == t, of(t)).otherwise(other), range(len(TEMPLATES)), F.lit(0.0))

    # files without any key phrase get no label and are finished without a join; their texts are not shuffled
    likely = may_hold_license(F.col(text))
    none = F.array().cast("array<struct<label:string,word:bigint,score:double>>")
    plain = docs.filter(~likely).select(
        "_row", count_words(F.col(text)).alias("n_words"), F.array().cast("array<struct<word:bigint,label:string>>").alias("base_places"), none.alias("matches"))
    keyed = docs.filter(likely).withColumns({"_h": row_key(text)[0], "_n": row_key(text)[1], "_w": license_words(F.col(text))})
    # only templates whose key phrase the file holds have candidates
    joined_text = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    tids = let(joined_text, lambda body: F.filter(F.array(*(F.when(F.contains(body, F.lit(f" {key} ")), t) for t, (_, key, _) in enumerate(TEMPLATES))), lambda t: t.isNotNull()))
    open_ = keyed.withColumn("_tids", tids).filter(F.size("_tids") > 0)
    hits = open_.select(id_col, "_h", "_n", "_tids", F.explode(placed_words(F.col("_w"))).alias("x")).select(id_col, "_h", "_n", "_tids", "x.pos", "x.word")
    # the index is fixed by the templates: a few dozen rows
    found = (
        hits.join(F.broadcast(index), "word").filter(F.array_contains("_tids", F.col("tid")))
        .groupBy(id_col, "_h", "_n").agg(F.collect_set(F.struct("tid", (F.col("pos") - F.col("tpos")).alias("off"))).alias("_found"))
    )
    joined = join_rows(keyed, found, "left", id_col)
    words = F.col("_w")

    def placed(phrase: str, label: str) -> Column:
        return F.transform(places(words, phrase), lambda i: F.struct(i.cast("long").alias("word"), F.lit(label).alias("label")))

    base = F.concat(*(placed(p, label) for p, label in PHRASES.items()))
    labels = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))
    scored = F.transform("_found", lambda m: F.struct(F.element_at(labels, m["tid"] + 1).alias("label"), m["off"].cast("long").alias("word"), share(words, m["tid"], m["off"]).alias("score")))
    matches = F.filter(scored, lambda m: m["score"] >= agree)
    held = joined.select(
        "_row", F.size("_w").cast("long").alias("n_words"), F.array_sort(base).alias("base_places"),
        F.when(F.col("_found").isNotNull(), F.array_sort(matches)).otherwise(none).alias("matches"))
    out = plain.unionByName(held).select(*(F.col(f"_row.`{c}`") for c in kept), "n_words", "base_places", "matches")
    best = F.aggregate("matches", F.lit(0.0), lambda a, m: F.greatest(a, m["score"]))
    return out.withColumns({
        "labels": F.array_sort(F.array_distinct(F.concat(F.transform("base_places", lambda b: b["label"]), F.transform("matches", lambda m: m["label"])))),
        "score": F.when(F.size("base_places") > 0, F.lit(1.0)).otherwise(best)})
