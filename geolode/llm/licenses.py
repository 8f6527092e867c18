"""License scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolode.llm.common import documents

# Phrases and passages of public licences, in lower case without punctuation, and the labels they give.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}
#: Words that tell licences apart: a span has those of its template, and no others.
MARKS = "0 1 2 3 4 affero apache artistic attribution boost bsd by cc0 commons eclipse gnu isc lesser library mit mozilla nc nd noncommercial sa sharealike unlicense zlib".split()
#: What stands for a template's words, in order of their first places, when spans are compared.
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
GRAMS = (2, 3)
LONG = 12
DRIFT = 3
MOST_WORDS = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def edits(size: int) -> int:
    """How many words of a template of that size may be changed, inserted or lost: a tenth, one at least from four words on, DRIFT at most."""
    return min(DRIFT, max(1, size // 10)) if size >= 4 else 0


def gram_of(size: int, own: bool) -> int:
    return GRAMS[not own and size >= LONG]


def votes_of(size: int, own: bool) -> int:
    """How many of a template's grams stand in every span within its edits: each edit breaks no more than a gram's length of them."""
    k = gram_of(size, own)
    return size - k + 1 - k * (0 if own else edits(size))


def listed(base: dict[str, str], templates: dict[str, str]) -> list[tuple[list[str], str, bool]]:
    """(words, label, whether it is a base phrase), checked: the list is joined as a broadcast, so its size is bounded."""
    out = [(p.split(), label, own) for own, group in ((True, base), (False, templates)) for p, label in group.items()]
    for words, _, _ in out:
        if len(words) < GRAMS[0] or not all(re.fullmatch(r"[a-z0-9]+", w) for w in words):
            raise ValueError(f"a template needs two words or more, in lower case: {' '.join(words)!r}")
        if len(set(words)) > len(LETTERS):
            raise ValueError(f"a template has {len(LETTERS)} different words at most: {' '.join(words)!r}")
    if sum(len(words) for words, _, _ in out) > MOST_WORDS:
        raise ValueError(f"templates have {MOST_WORDS} words in all at most")
    return out


def template_grams(spark, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(gram, template, at, w, size, label, own, edits, least): every k-gram of every template."""
    rows = []
    for number, (words, label, own) in enumerate(listed(base, templates)):
        size, k = len(words), gram_of(len(words), own)
        rows += [(number, at, words[at : at + k], size, k, label, own, 0 if own else edits(size), votes_of(size, own)) for at in range(size - k + 1)]
    made = spark.createDataFrame(rows, "template int, at int, w array<string>, size int, k int, label string, own boolean, edits int, least int")
    three = F.xxhash64(F.col("w")[0], F.col("w")[1], F.get("w", F.lit(2)))
    return made.withColumn("gram", F.when(F.col("k") == 3, three).otherwise(F.xxhash64(F.col("w")[0], F.col("w")[1])))


def template_codes(spark, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(template, vocabulary, coded, marks): each template as a text of one letter a word."""
    rows = []
    for number, (words, _, _) in enumerate(listed(base, templates)):
        known = list(dict.fromkeys(words))
        letter = dict(zip(known, LETTERS, strict=False))
        rows.append((number, known, "".join(letter[w] for w in words), [letter[w] for w in known if w in MARKS]))
    return spark.createDataFrame(rows, "template int, vocabulary array<string>, coded string, marks array<string>")


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to one row each: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All rolling hashes of two and of three words of every whole text are joined to the places of these grams in the templates, which are
    few and travel to the tasks. A hit votes for the diagonal (place in the text less place in the template). Base phrases
    count where all of a phrase's pairs stand on one diagonal. Other templates gather the votes of a diagonal and of the DRIFT next, as
    an inserted or a lost word shifts the rest; a band has that width, however many diagonals follow each other. With as many votes as any
    span within a template's ``edits`` must have, the spans that begin near the diagonal are verified: the least word edit distance
    counts if it is within the edits and the span has the template's MARKS and no others. ``score`` is the largest share of a template that
    is unchanged, or 1 for a base phrase; 0 without any. Null and empty texts have no words, no labels (empty strings) and null places. Rows are told apart
    by their place in the scan, so repeated rows and null ids each get their own result. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    grams, codes = F.broadcast(template_grams(spark, base, templates)), F.broadcast(template_codes(spark, base, templates))
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower()), SPLIT), "")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words.alias("words"))
    flat = rows.select("rid", "doc_id", "words", F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "word"))
    flat = flat.select("rid", "doc_id", "words", (F.col("pos") - 1).alias("pos"), "word", F.get("words", F.col("pos")).alias("second"), F.get("words", F.col("pos") + 1).alias("third"))
    flat = flat.select("*", F.explode(F.array(F.xxhash64("word", "second"), F.xxhash64("word", "second", "third"))).alias("hash"))
    same = (F.col("hash") == F.col("gram")) & (F.col("word") == F.col("w")[0]) & (F.col("second") == F.col("w")[1]) & ((F.col("k") == 2) | (F.col("third") == F.get("w", F.lit(2)))) & (F.col("pos") >= 0)
    hits = flat.join(grams, same, "left").filter("pos < 0 or template is not null").withColumn("diagonal", F.col("pos") - F.col("at"))
    origin = F.greatest(F.col("diagonal") - F.col("edits"), F.lit(0))
    around = F.slice("words", origin + 1, F.greatest(F.col("diagonal") + F.col("size") + 2 * F.col("edits") - origin, F.lit(0)))
    facts = ("doc_id", "n_words", "size", "k", "label", "own", "edits", "least")
    hits = hits.select("rid", "template", "diagonal", "at", F.when(~F.col("own"), around).alias("around"), F.size("words").cast("bigint").alias("n_words"), *[c for c in facts if c != "n_words"])
    diagonals = hits.groupBy("rid", "template", "diagonal").agg(*[F.any_value(c).alias(c) for c in facts], F.any_value("around").alias("around"), F.collect_set("at").alias("at"))
    band = Window.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    votes = F.when(F.col("own"), F.size("at")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("at").over(band)))))
    likely = diagonals.withColumn("votes", votes).withColumn("likely", F.coalesce(F.col("votes") >= F.col("least"), F.lit(False)))
    likely = likely.join(codes, "template", "left")
    letter = lambda w: F.when(F.array_contains("vocabulary", w), F.substring(F.lit(LETTERS), F.array_position("vocabulary", w).cast("int"), F.lit(1))).when(w.isin(MARKS), "!").otherwise("?")
    text = F.when(F.col("likely") & ~F.col("own"), F.array_join(F.transform("around", letter), ""))
    likely = likely.withColumn("text", text)
    starts = F.sequence(F.lit(0), F.greatest(F.col("diagonal") + F.col("edits") - origin, F.lit(0)).cast("int"))
    sizes = F.sequence(F.col("size") - F.col("edits"), F.col("size") + F.col("edits"))
    spans = F.flatten(F.transform(starts, lambda a: F.transform(sizes, lambda n: F.substring(F.col("text"), a + 1, n))))
    marked = F.filter(F.array_distinct(spans), lambda x: (F.instr(x, "!") == 0) & F.forall("marks", lambda m: F.contains(x, m)))
    least = F.array_min(F.transform(marked, lambda x: F.levenshtein(x, F.col("coded"))))
    distance = F.when(F.col("own"), 0).otherwise(least)
    found = likely.withColumn("distance", F.when(F.col("likely"), distance))
    found = found.withColumn("good", F.coalesce(F.col("distance") <= F.col("edits"), F.lit(False)))
    own = F.col("good") & F.col("own")
    join = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    return found.groupBy("rid").agg(
        F.any_value("doc_id").alias("doc_id"),
        F.any_value("n_words").alias("n_words"),
        F.count(F.when(own, 1)).alias("n_base"),
        F.min(F.when(own, F.col("diagonal"))).cast("bigint").alias("first_word"),
        F.max(F.when(own, F.col("diagonal"))).cast("bigint").alias("last_word"),
        join(own).alias("base_labels"),
        join(F.col("good")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), 1 - F.col("distance") / F.col("size"))), F.lit(0.0)).alias("score"),
    ).drop("rid")


def op7_diagonal_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))
