"""License scans by a positional rare-token index.

Templates are passages of licences with the key phrases that must stand in them. The index has a posting
(word, template, position) for the rarest words of each template, by inverse document frequency over all
documents. A file's licence words that have postings propose where a template may start (word position
minus posting position); a start is followed up if enough of the template's rare words agree on it; then
the key phrases are looked for in the words at that place. A base phrase is a template that is its own
only key phrase and must stand word for word.

The scan is one pass without a shuffle of texts: besides its hits each document keeps the row of its last
word. The postings are a fixed table of a few hundred rows, so their broadcast is bounded.

Defined results: null and word-free texts have no words, no places, empty labels and score 0; repeated
rows are documents of their own; overlapping places count each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm._io import table
from lectorium.llm._text import word_count, words

#: The base phrases and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Label, passage and key phrases. Public licence wording.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["licensed under the apache license", "in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "the following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["under the terms of the gnu general public license", "free software foundation"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license", "free software foundation"]),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license", "free software foundation"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["subject to the terms of the mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["under the terms of the eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "authors be held liable for any damages"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["licensed under a creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("proprietary", "copyright all rights reserved unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", ["unauthorized copying of this file", "strictly prohibited"]),
]

#: Rare words indexed of each passage, how many must agree on a start, by how many words an edited copy
#: may be longer or shifted before its key phrases leave the words looked at, and key phrases at most.
RARE, AGREE, SLACK, PHRASES = 8, 3, 12, 2


def templates() -> list[dict]:
    out = [{"label": label, "words": phrase.split(), "phrases": [phrase], "base": True} for label, phrase in BASE]
    return out + [{"label": label, "words": text.split(), "phrases": phrases, "base": False} for label, text, phrases in PASSAGES]


def vocabulary() -> list[str]:
    return sorted({w for t in templates() for w in t["words"]})


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many rows of docs(w array) each licence word stands, and how many rows there are. The result
    has a number for each word of the vocabulary, however large the table."""
    found = F.array_intersect("w", F.array(*map(F.lit, vocabulary())))
    counted = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word")).groupBy("word").count()
    frequencies = {r["word"]: r["count"] for r in counted.collect()}
    return frequencies, frequencies.pop("", 0)


def postings(frequencies: dict[str, int], n_docs: int) -> list[tuple]:
    """The index: a row per posting with its word, template, position and rank among the template's rare
    words, and what a start that it proposes is held against."""
    idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) for w in vocabulary()}
    rows = []
    for t, x in enumerate(templates()):
        first = {}
        for i, w in enumerate(x["words"]):
            first.setdefault(w, i)
        rare = sorted(first, key=lambda w: (-idf[w], first[w]))[: 1 if x["base"] else RARE]
        padded = [y for w in rare for y in (w, first[w])] + [None, None] * (RARE - len(rare))
        phrases = [f" {p} " for p in x["phrases"]] + [None] * (PHRASES - len(x["phrases"]))
        for rank, w in enumerate(rare):
            rows.append((w, t, first[w], rank, x["label"], x["base"], len(x["words"]), 1 if x["base"] else min(AGREE, len(rare)), 0 if x["base"] else SLACK, x["words"], *padded, *phrases))
    return rows


_SCHEMA = ", ".join(
    ["word string, template int, position int, rank int, label string, base boolean, size int, need int, slack int, passage array<string>"]
    + [f"rare{i} string, at{i} int" for i in range(RARE)]
    + [f"phrase{i} string" for i in range(PHRASES)]
)


def scan(docs: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and spans (array of struct of label, start and size in words of what was found)."""
    d = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    rows = postings(*document_frequencies(d))
    index = docs.sparkSession.createDataFrame(rows, _SCHEMA)
    at = d.select("doc_id", "row", "w", F.posexplode("w").alias("at", "word"))
    last = F.col("at") == F.size("w") - 1
    # Few rows pass here; what follows would be slow for each word.
    at = at.filter(last | F.col("word").isin(sorted({r[0] for r in rows})))
    hit = at.join(F.broadcast(index), "word", "left")
    start = F.col("at") - F.col("position")
    agrees = [F.coalesce(F.get("w", start + F.col(f"at{i}")) == F.col(f"rare{i}"), F.lit(False)) for i in range(RARE)]
    agree = sum((x.cast("int") for x in agrees[1:]), agrees[0].cast("int"))
    leads = F.coalesce(*[F.when(x, F.lit(i)) for i, x in enumerate(agrees)]) == F.col("rank")  # each start once, by its rarest word
    from_ = F.greatest(start - F.col("slack"), F.lit(0))
    window = F.concat(F.lit(" "), F.array_join(F.slice("w", from_ + 1, F.greatest(F.lit(0), start + F.col("size") + F.col("slack") - from_)), " "), F.lit(" "))
    inside = ~F.col("base") | ((start >= 0) & (start + F.col("size") <= F.size("w")))
    verified = F.col("template").isNotNull() & (agree >= F.col("need")) & leads & inside
    for i in range(PHRASES):
        verified = verified & (F.col(f"phrase{i}").isNull() | (F.instr(window, F.col(f"phrase{i}")) > 0))
    ok = F.coalesce(verified, F.lit(False))
    hit = hit.filter(last | ok).withColumn("start", start).withColumn("last", last).withColumn("ok", ok)
    equal = F.size(F.filter(F.zip_with("passage", F.transform("passage", lambda x, i: F.get("w", F.col("start") + i)), lambda a, b: a == b), lambda x: x))
    score = F.when(F.col("base"), F.lit(1.0)).otherwise(0.5 + 0.5 * equal / F.col("size"))
    kept = hit.select(
        "doc_id", "row", F.when(F.col("last"), word_count(F.col("w"))).alias("n"), F.when(F.col("ok"), F.struct("label", "start", "size", "base")).alias("span"), F.when(F.col("ok"), score).alias("score")
    )
    base = F.col("span")["base"]
    per = kept.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n_words"),
        F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("span")["start"])).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("span")["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("span")["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.col("span")["label"])), ",").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list("span")).alias("spans"),
    )
    return per.drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names or quotes."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
