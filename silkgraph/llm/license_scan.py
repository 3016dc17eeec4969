"""Licence scan over a positional index of rare licence words. Native.

1. One narrow pass over the words of all documents finds the licence words of
   each and the places of the base phrases. Only documents with all words of
   some template's key phrase keep their words.
2. The document frequencies of the licence words over all documents order them.
3. A file looks up the postings of its rarest word of each such key phrase,
   never those of common words: the word's places in the file, shifted by its
   place in the phrase, are where the phrase may stand. They are intersected
   with the shifted places of the next rarest word, and what is left is
   verified against the whole key phrase, which decides on the label. No place
   of a key phrase is lost, as its rarest word stands there too.
4. The share of the weight of the file's rarest words of the template that
   stand where its wording has them is the score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.llm.common import materialize, norm_words, table

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Licence wordings: label, normalised text (the head of a licence, or how files name it), mandatory key phrase.
TEMPLATES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "governed by a bsd style license"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "copyright and related and neighboring rights"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "published by the free software foundation either version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "published by the free software foundation either version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable"),
]
#: Rare words of a template that a document is scored by, of those that it has.
RARE_WORDS = 4
LICENCE_WORDS = sorted({w for _, text, _ in TEMPLATES for w in text.split()} | {w for p in PHRASES for w in p.split()})


def index(spark: SparkSession) -> DataFrame:
    """``template, label, key, parts, key_at, wording``: ``parts`` are the postings of the key phrase, each word with its (first) place there. A row per template."""
    rows = []
    for t, (label, text, phrase) in enumerate(TEMPLATES):
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows.append((t, label, key, [(w, key.index(w)) for w in dict.fromkeys(key)], at, words))
    return spark.createDataFrame(rows, "template int, label string, key array<string>, parts array<struct<word: string, place: int>>, key_at int, wording array<string>")


def _list(words) -> Column:
    return F.array(*map(F.lit, words))


def _all_in(words: list[str], has: Column) -> Column:
    return F.size(F.array_except(_list(words), has)) == 0


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _base_places(phrase: list[str], label: str) -> Column:
    """``(pos, base)`` of the places where the words ``w`` have the phrase."""

    def here(i: Column) -> Column:
        same = F.get("w", i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            same &= F.coalesce(F.get("w", i + k) == word, F.lit(False))
        return same

    at = F.transform(F.filter(_numbers(F.size("w")), here), lambda i: F.struct(i.alias("pos"), F.lit(label).alias("base")))
    return F.when(_all_in(phrase, F.col("has")), at).otherwise(F.array().cast("array<struct<pos: int, base: string>>"))


def scan(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, n_words, has, base, open, w`` per row of ``docs``.

    ``has`` are its licence words, ``base`` the ``(pos, label)`` of the base
    phrases, ``open`` the templates of whose key phrase it has all words, and
    ``w`` its words where there is one, else null.
    """
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), norm_words(F.col("text")).alias("w"))
    known = words.select("doc_id", "rid", "w", F.array_intersect("w", _list(LICENCE_WORDS)).alias("has"))
    base = F.concat(*[_base_places(phrase.split(), label) for phrase, label in PHRASES.items()])
    open_ = F.array_compact(F.array(*[F.when(_all_in(phrase.split(), F.col("has")), F.lit(t)) for t, (_, _, phrase) in enumerate(TEMPLATES)]))
    found = known.select("rid", "doc_id", F.size("w").alias("n_words"), "has", base.alias("base"), open_.alias("open"), "w")
    return found.withColumn("w", F.when(F.size("open") > 0, F.col("w")))


def verified(seen: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A row per place of a template's key phrase: ``rid, has, label, wording``, and the words ``there`` that the wording is compared with.

    Words missing ``there`` before the document's start are cut off: ``cut`` of them.
    """
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    tried = seen.where(F.size("open") > 0).select("rid", "has", "w", F.explode("open").alias("template")).join(F.broadcast(index(seen.sparkSession)), "template")
    by_rarity = F.array_sort(F.transform("parts", lambda p: F.struct((-known[p["word"]]).alias("x"), p["word"].alias("word"), p["place"].alias("place"))))
    ranked = tried.withColumn("first", F.get(by_rarity, F.lit(0))).withColumn("second", F.get(by_rarity, F.lit(1)))
    posted = F.transform(F.filter(_numbers(F.size("w")), lambda i: F.get("w", i) == F.col("first.word")), lambda i: i - F.col("first.place"))
    both = F.filter("starts", lambda s: (s >= 0) & (F.col("second").isNull() | F.coalesce(F.get("w", F.greatest(s, F.lit(0)) + F.col("second.place")) == F.col("second.word"), F.lit(False))))
    places = F.filter("starts", lambda s: F.slice("w", s + 1, F.size("key")) == F.col("key"))
    held = ranked.withColumn("starts", posted).withColumn("starts", both).withColumn("starts", places)
    one = held.select("rid", "has", "w", "label", "wording", "key_at", F.explode("starts").alias("pos"))
    cut = F.greatest(F.col("key_at") - F.col("pos"), F.lit(0))
    there = F.slice("w", F.greatest(F.col("pos") - F.col("key_at"), F.lit(0)) + 1, F.size("wording") - cut)
    return one.select("rid", "has", "label", "wording", cut.alias("cut"), there.alias("there"))


def agreement(weights: dict[str, float]) -> Column:
    """Share of the weight of the document's rarest words of a template that stand where the template has them."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    ranked = F.array_sort(F.transform(F.array_intersect("wording", "has"), lambda w: F.struct((-known[w]).alias("x"), w.alias("w"))))
    rare = F.slice(ranked, 1, RARE_WORDS)
    meet = F.transform("wording", lambda w, i: F.when(F.get("there", i - F.col("cut")) == w, w))
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda acc, r: acc - r["x"])
    return total(F.filter(rare, lambda r: F.coalesce(F.array_contains(meet, r["w"]), F.lit(False)))) / total(rare)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null text is empty. Labels are those of the base phrases and of all
    templates whose key phrase the document has. Documents without a licence
    have empty labels and the score 0; base phrases alone give the score 1;
    otherwise the score is the best share of rare-word weight that agrees with
    a place, of the document's own rarest words of the template. Repeated rows
    give a row each. Other columns of ``docs`` are ignored.
    """
    seen = materialize(scan(docs), "licence")
    # the null word of every document counts the documents
    df = {r["word"]: r["n"] for r in seen.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), "has")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    weights = {w: math.log((df.get(None, 0) + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in LICENCE_WORDS}
    verdicts = verified(seen, weights).select("rid", "label", F.least(agreement(weights), F.lit(1.0)).alias("share"))
    best = verdicts.groupBy("rid").agg(F.collect_set("label").alias("m"), F.max("share").alias("best"))
    at = F.transform("base", lambda b: b["pos"].cast("long"))
    merged = seen.join(best, "rid", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.transform("base", lambda b: b["base"]).alias("b"), F.coalesce("m", F.array().cast("array<string>")).alias("m"), "best",
    )
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return merged.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", joined(F.col("b")).alias("base_labels"),
        joined(F.concat("b", "m")).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.round(F.coalesce("best", F.lit(0.0)), 9)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
