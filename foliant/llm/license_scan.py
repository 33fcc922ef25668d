"""License scans: diagonal voting. Word k-grams of texts meet those of license notices, and hits on one diagonal are a place.

A text's word at p and a notice's word at q lie on the diagonal p - q, so one copy of the notice votes for one diagonal,
and an edited copy for neighbouring ones, as a word more or less moves the rest by one. Spark joins the k-grams' hashes
(and the k-grams themselves, so that hashes decide nothing), groups the hits by diagonal and merges diagonals that lie no
farther apart than a notice may have edits. By the k-gram lemma a copy within e edits keeps all but k times e of the
notice's k-grams, so what has fewer votes is none. The places that are left are verified word by word.

Texts that share no k-gram with a notice are told in the row, by their hashes: they give no rows to the join, and their
text stays where it lies.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import written

K = 3
#: A notice of fewer words must stand word by word; a longer one may have one edit in five words.
EXACT_UNDER, NEAR = 20, 0.8
#: Notices of a scan may have so many k-grams in all; they are sent to every task.
MAX_GRAMS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that name a license (fixed values).
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: The usual notices of public licenses and what names them without doubt.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("cc0-1", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by", "cc by 4 0"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("gpl-2", "GNU General Public License version 2"),
    ("gpl-3", "GNU General Public License version 3"),
    ("agpl-3", "GNU Affero General Public License version 3"),
    ("lgpl-2.1", "GNU Lesser General Public License version 2 1"),
    ("lgpl-3", "GNU Lesser General Public License version 3"),
    ("mpl-2", "Mozilla Public License version 2"),
    ("bsd", "BSD 2 Clause License"),
    ("bsd", "BSD 3 Clause License"),
)

SPANS = "array<struct<label: string, base: boolean, start: long, end: long, score: double>>"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def edits(n_words: int) -> int:
    """The most edits of a place of a notice of so many words."""
    return 0 if n_words < EXACT_UNDER else int(round(n_words * (1 - NEAR), 6))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """The k-grams of a column of words, joined by spaces; none where there are fewer words."""
    at = F.when(F.size(words) >= K, F.sequence(F.lit(0), F.size(words) - K)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(K)]))


def nearest(notice: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the run of words that is nearest to the notice, the first of the shortest ones."""

    def ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fewest edits from all of a to some run of b that ends at each place."""
        at = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        for i, w in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = i
            np.minimum(row[:-1] + (b != w), row[1:] + 1, out=new[1:])
            row = np.minimum.accumulate(new - at) + at
        return row

    forth = ends(notice, words)
    best, end = int(forth.min()), int(forth.argmin())
    back = ends(notice[::-1], words[:end][::-1])
    return best, end - int(np.flatnonzero(back == best)[0]), end


def verified(words: list[str], places: list[tuple[int, int, int]], notices: list[tuple]) -> list[dict]:
    """Spans of the places (notice, first diagonal, last diagonal) that hold the notice, by start, end and label.

    notices are (label, base, words). Of spans with edits, those that overlap one of another label with a higher score go.
    """
    found = []
    for which, low, high in places:
        label, base, notice = notices[which]
        n, most = len(notice), edits(len(notice))
        if not most:
            found += [(at, at + n, label, base, 1.0) for at in range(low, high + 1) if words[at : at + n] == notice]
            continue
        code = {w: i for i, w in enumerate(dict.fromkeys(notice))}
        parts = [(max(low - most, 0), min(high + n + most, len(words)))]
        ids = np.array([code.get(w, -1) for w in words[parts[0][0] : parts[0][1]]], np.int64)
        own, off = np.array([code[w] for w in notice], np.int64), parts[0][0]
        while parts:
            a, b = parts.pop()
            if b - a >= n - most:
                d, start, end = nearest(own, ids[a - off : b - off])
                if d <= most:
                    found.append((a + start, a + end, label, base, 1 - d / n))
                    parts += [(a, a + start), (a + end, b)]
    found = sorted(set(found))
    longest = max((b - a for a, b, *_ in found), default=0)
    out = []
    for i, (a, b, label, base, score) in enumerate(found):
        better = False
        if score < 1:
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(found) and a - longest < found[j][0] < b and not better:
                    better = found[j][1] > a and found[j][2] != label and found[j][4] > score
                    j += step
        if not better:
            out.append({"label": label, "base": base, "start": a, "end": b, "score": score})
    return out


def _votes(texts: DataFrame, notices: list[tuple]) -> DataFrame:
    """(key, notice, low, high): merged diagonals with votes enough, of texts (key, text)."""
    rows = [(" ".join(w[q : q + K]), i, q) for i, (_, _, w) in enumerate(notices) for q in range(len(w) - K + 1)]
    grams = texts.sparkSession.createDataFrame(rows, "gram string, notice int, q int").withColumn("h", F.xxhash64("gram"))
    sizes = texts.sparkSession.createDataFrame([(i, edits(len(w)), len(w) - K + 1 - K * edits(len(w))) for i, (_, _, w) in enumerate(notices)], "notice int, most int, least int")
    words = texts.select("key", _words(F.col("text")).alias("words"))
    places = words.select("key", F.posexplode(_grams(F.col("words"))).alias("p", "gram")).withColumn("h", F.xxhash64("gram"))
    hits = places.join(F.broadcast(grams), ["h", "gram"]).select("key", "notice", (F.col("p") - F.col("q")).alias("diagonal"), "q")
    lines = hits.groupBy("key", "notice", "diagonal").agg(F.collect_set("q").alias("seen")).join(F.broadcast(sizes), "notice")
    along = Window.partitionBy("key", "notice").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("most"), F.lit(True))
    merged = lines.withColumn("group", F.sum(apart.cast("long")).over(along)).groupBy("key", "notice", "group", "least")
    merged = merged.agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"))
    return merged.where("votes >= least").select("key", "notice", "low", "high")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) of every row of docs: where a license is named or its notice stands in the whole text.

    Words are runs of digits, letters and all signs beyond ASCII in the text with A-Z lower-cased; phrases and notices are
    (label, text) of K words or more, MAX_GRAMS in all. A span has its label, whether it is a phrase's, start and end in
    words, and its score: 1, or in longer notices the share of words without an edit. Spans are by start; a place that
    holds several notices has them all, but for those with edits where another label's span overlaps with a higher score.

    A null or empty text has no word and no span; rows without an id and repeated rows are kept, an empty table gives no
    rows, and other columns of docs are left out, whatever their names.
    """
    all_ = [(label, base, words_of(text)) for base, given in ((True, phrases), (False, notices)) for label, text in given]
    if any(len(w) < K for _, _, w in all_):
        raise ValueError(f"phrases and notices have {K} words or more")
    grams = sorted({" ".join(w[q : q + K]) for _, _, w in all_ for q in range(len(w) - K + 1)})
    if len(grams) > MAX_GRAMS:
        raise ValueError(f"{len(grams)} k-grams of notices, of {MAX_GRAMS} that may be sent to every task")
    spark = docs.sparkSession
    hashes = [r.h for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g").alias("h")).collect()] if grams else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("words", _words(F.col("text")))
    rows = rows.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), F.transform(_grams(F.col("words")), lambda g: F.xxhash64(g)).alias("own"))
    known = F.split(F.lit(",".join(map(str, hashes))), ",") if hashes else F.array()
    shared = F.arrays_overlap("own", known.cast("array<bigint>"))
    key = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)), 1, 16)
    rows = written(rows.select("doc_id", "n_words", key.alias("key"), F.when(shared, F.col("text")).alias("text")), "license-texts")
    texts = rows.where("text IS NOT NULL").select("key", "text")

    @F.pandas_udf(SPANS)
    def verify(bodies: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([verified(words_of(t), [(p["notice"], p["low"], p["high"]) for p in ps], all_) for t, ps in zip(bodies, places)])

    places = _votes(texts, all_).groupBy("key").agg(F.collect_list(F.struct("notice", "low", "high")).alias("places"))
    spans = texts.join(places, "key").select("key", verify("text", "places").alias("spans"))
    spans = spans.groupBy("key").agg(F.first("spans").alias("spans"))
    return rows.drop("text").join(spans, "key", "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def labels(spans: Column) -> Column:
    """Distinct labels of spans, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
