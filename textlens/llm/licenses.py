"""License scans: word k-grams of documents vote for places in license texts, diagonal by diagonal; the spans that votes
point to are then aligned with the license text, word for word."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlens.llm.common import map_columns, small_side, stored

K = 3
#: Phrases that give their label wherever their words stand one after another (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening or grant passages of common licenses, from their public texts (fixed values).
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software""",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
}
#: Words that tell a license from its kin: (needed, barred) in the aligned span (fixed values). Two neighbouring words also
#: count written as one, so that "Non-Commercial" is "noncommercial".
_OTHER_CC = {"sharealike", "noderivatives", "noderivs", "sa", "nd"}
TELLS: dict[str, tuple[set[str], set[str]]] = {
    "mit": ({"deal"}, {"dealwith"}),  # NCSA grants "to deal with the Software"
    "apache-2": ({"apache", "2"}, set()),
    "gpl": ({"gnu"}, {"lesser", "affero", "gnulibrary"}),
    "mpl-2": ({"mozilla", "2"}, set()),
    "isc": ({"provided"}, set()),
    "unlicense": ({"unencumbered"}, set()),
    "cc-by": ({"attribution"}, {"noncommercial", "nc"} | _OTHER_CC),
    "cc-by-nc": ({"attribution", "noncommercial"}, _OTHER_CC),
}
#: A span may stretch over this many times the k-grams of its license text.
STRETCH = 1.5
#: Diagonals at most this far apart are one match with words put in or left out.
NEAR = 3
#: Least share of a license text's k-grams that a match must hold to give its label.
SHARE = 0.75
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def gram_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each run of K words."""
    if len(words) < K:
        return np.empty(0, np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - K + 1
    rolled = one[:n].copy()
    for j in range(1, K):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + one[j : n + j]
    rolled ^= rolled >> np.uint64(32)
    return rolled.view(np.int64)


def template_rows(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(hash, template, label, base, size, at): every k-gram of the phrases and license texts; a few hundred rows."""
    rows = []
    both = [(text, label, True) for text, label in phrases.items()] + [(text, label, False) for label, text in templates.items()]
    for i, (text, label, base) in enumerate(both):
        grams = gram_hashes(words_of(text.encode())).tolist()
        if not grams:
            raise ValueError(f"a phrase needs {K} words: {text}")
        rows += [(h, i, label, base, len(grams), at) for at, h in enumerate(grams)]
    return spark.createDataFrame(rows, "hash bigint, template int, label string, base boolean, size int, at int")


def diagonal_votes(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Votes of each document, text and diagonal: key, template, label, base, size, diagonal, votes, low, high.

    key is a hash of doc_id and text. votes counts the different template k-grams found on the diagonal (word position
    less template position), low and high are the first and last such place in the text. All grams of all texts join the
    template grams; these are the fixed texts above, so the broadcast does not grow with the data.
    """

    def make(part: dict[str, list]) -> dict[str, object]:
        return {"key": part["key"], "grams": [gram_hashes(words_of(text)) for text in part["text"]]}

    keyed = documents.select(row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    grams = map_columns(keyed, "key bigint, grams array<bigint>", make, rows=256)
    grams = grams.select("key", F.posexplode("grams").alias("place", "hash"))
    hits = grams.join(F.broadcast(template_rows(documents.sparkSession, phrases, templates)), "hash")
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    once = hits.groupBy("key", "template", "label", "base", "size", "diagonal", "at").agg(F.max("place").alias("place"))
    return once.groupBy("key", "template", "label", "base", "size", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("place").alias("low"), F.max("place").alias("high")
    )


def row_key():
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def merged_matches(votes: DataFrame) -> DataFrame:
    """Neighbouring diagonals of a document and license text, at most `NEAR` apart, as one span to be aligned: key,
    template, label, size, lines (diagonals), votes (of all diagonals, so one template place may count more than once),
    low, high."""
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    gap = (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR) | F.lag("diagonal").over(order).isNull()
    runs = votes.withColumn("fresh", gap.cast("int")).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("key", "template", "label", "size", "run").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def gram_places(words: list[bytes]) -> dict[tuple[bytes, ...], int]:
    """Each run of K words with its places as bits."""
    places: dict[tuple[bytes, ...], int] = {}
    for at in range(len(words) - K + 1):
        gram = tuple(words[at : at + K])
        places[gram] = places.get(gram, 0) | 1 << at
    return places


def aligned_spans(words: list[bytes], low: int, high: int, places: dict[tuple[bytes, ...], int], size: int):
    """(k-grams in common order, first word, last word) of the best alignment from every k-gram of ``words`` between the
    places low and high that the license text has, over at most `STRETCH` times its size.

    Each place of the license text and of the words is used once: this is the longest common subsequence of the k-grams
    themselves (not of their hashes), one bit for each place of the license text.
    """
    hits = [(at, places[g]) for at in range(low, high + 1) if (g := tuple(words[at : at + K])) in places]
    full = (1 << size) - 1
    for i, (start, _) in enumerate(hits):
        free, end = full, start
        for at, bits in hits[i:]:
            if at - start > STRETCH * size:
                break
            use = free & bits
            left = ((free + use) | (free - use)) & full
            if left.bit_count() < free.bit_count():
                end = at
            free = left
        yield size - free.bit_count(), start, end + K - 1


def tells(label: str, words: list[bytes]) -> bool:
    """Whether the words of a span hold all that its label needs and nothing that tells of another license."""
    needed, barred = TELLS.get(label, (set(), set()))
    own = {w.decode("utf-8", "replace") for w in words}
    own |= {(a + b).decode("utf-8", "replace") for a, b in zip(words, words[1:])}
    return needed <= own and not barred & own


def best_labels(found: list[tuple[float, int, int, str]]) -> list[str]:
    """Labels of spans (share, first word, last word, label), where of two that overlap by more than half of the shorter
    one only that of the larger share counts, the longer one at equal shares."""
    taken: list[tuple[int, int, str]] = []
    for _, first, last, label in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[3], f[1])):
        for a, b, _ in taken:
            if 2 * (min(b, last) - max(a, first) + 1) > min(b - a, last - first) + 1:
                break
        else:
            taken.append((first, last, label))
    return sorted({label for _, _, label in taken})


def verified(documents: DataFrame, spans: DataFrame, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """key, share (the largest of an alignment) and more (labels that hold) of the documents that own ``spans``.

    Only texts with a span leave their place: their keys, eight bytes each, are sent to the texts if they are few.
    """
    texts = documents.select(row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(small_side(spans.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    own = spans.groupBy("key").agg(
        F.collect_list("template").alias("template"), F.collect_list("low").alias("low"), F.collect_list("high").alias("high")
    )  # at most as many as the text has words
    known = {len(phrases) + i: (label, words_of(text.encode())) for i, (label, text) in enumerate(templates.items())}

    def check(part: dict[str, list]) -> dict[str, object]:
        grams = {i: gram_places(words) for i, (_, words) in known.items()}
        shares, labels = [], []
        for text, *lists in zip(part["text"], part["template"], part["low"], part["high"], strict=True):
            words, most, found = words_of(text), 0.0, []
            for i, low, high in zip(*lists, strict=True):
                label, size = known[i][0], len(known[i][1]) - K + 1
                for votes, first, last in aligned_spans(words, low, high, grams[i], size):
                    most = max(most, votes / size)
                    if votes >= SHARE * size and tells(label, words[first : last + 1]):
                        found.append((votes / size, first, last, label))
            shares.append(most)
            labels.append(best_labels(found))
        return {"key": part["key"], "share": shares, "more": labels}

    return map_columns(texts.join(own, "key"), "key bigint, share double, more array<string>", check, rows=256)


def license_scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of ``documents``.

    A place of a phrase is a diagonal on which all its k-grams vote; n_base counts them, first_word and last_word are the
    smallest and largest (null without any). The span of neighbouring diagonals is aligned with the license text: it gives its
    label if at least `SHARE` of the k-grams stand in it in order, each once, over at most `STRETCH` times their number,
    the words that tell it from its kin (`TELLS`) hold, and no other license text fits the same words better. score is 1
    with a phrase, else the largest share aligned, with or without a label. Null texts are empty: 0 words, empty labels, score 0. Repeated rows get the same result;
    columns other than doc_id and text are ignored; an empty table gives an empty table.
    """
    votes = stored(diagonal_votes(documents, phrases, templates), "votes")
    exact = votes.filter("base AND votes = size").select("key", "label", F.col("diagonal").alias("start"))
    base = exact.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("start").alias("first"), F.max("start").alias("last"), F.collect_set("label").alias("own")
    )  # a set of at most as many labels as there are phrases
    match = stored(merged_matches(votes.filter("NOT base")), "spans")
    sure = (F.col("lines") == 1) & (F.col("votes") < SHARE * F.col("size"))  # one diagonal is an alignment already
    none = F.array().cast("array<string>")
    under = match.filter(sure).select("key", (F.col("votes") / F.col("size")).alias("share"), none.alias("more"))
    other = under.union(verified(documents, match.filter(~sure), phrases, templates))
    other = other.groupBy("key").agg(F.max("share").alias("share"), F.flatten(F.collect_list("more")).alias("more"))

    def count(part: dict[str, list]) -> dict[str, object]:
        return {"doc_id": part["doc_id"], "key": part["key"], "n_words": [len(words_of(text)) for text in part["text"]]}

    rows = documents.select("doc_id", row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    rows = map_columns(rows, "doc_id bigint, key bigint, n_words bigint", count, rows=256)
    full = rows.join(base, "key", "left").join(other, "key", "left")
    own, more = F.coalesce("own", none), F.coalesce("more", none)
    return full.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first").cast("bigint").alias("first_word"),
        F.col("last").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
