"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license notices.

A block is a run of consecutive words of a text, as long as the notice and a quarter more, wherever it begins and whatever
lines, comment marks or signs it spans; it matches a notice if it holds at least ``threshold`` of the notice's distinct words
(containment). The join orders the notices' words by how often they stand in all texts, rarest first, and then looks only
at blocks that hold a word of some notice's prefix (prefix filter: a match must, with prefixes of |T| - need + 1 words),
in stretches that are long enough (length filter) and can still reach the needed overlap from the rarest of the notice's
words that they hold (positional filter); what is left is counted exactly, all blocks of a stretch at once. The notices are
a parameter of bounded size and travel to the tasks; texts are not shuffled.

A null text is empty and has no places; repeated rows are judged one by one; a notice without words never matches; columns
called like the results go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, read, row_without
from .textbytes import ALNUM_WORDS, chunks, hash_slices, lower, tidy, words

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and their labels.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "Copyright all rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
RESULTS = ("n_words", "places", "matches")


def block_words(n: int) -> int:
    """Words of the blocks that are compared with a notice of n words."""
    return n + (n + 3) // 4


def _hashes(text: str) -> np.ndarray:
    for _, offsets, data in chunks(pa.array([text])):
        data = lower(data)
        starts, ends, _ = words(data, offsets, ALNUM_WORDS)
        return hash_slices(data, starts, ends)
    return np.zeros(0, np.uint64)


def _vocabulary(notices: dict[str, str]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[_hashes(t) for t in notices.values()]]))


def _frequencies(vocabulary: np.ndarray):
    def run(batches):
        total = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for batch in batches:
            for _, offsets, data in chunks(batch.column(0)):
                data = lower(data)
                starts, ends, _ = words(data, offsets, ALNUM_WORDS)
                total += np.bincount(_place(vocabulary, hash_slices(data, starts, ends)), minlength=len(total))
        yield pa.record_batch([pa.array(np.arange(len(vocabulary), dtype=np.int64)), pa.array(total[:-1])], ["place", "n"])

    return run


def _place(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place in the sorted vocabulary; its length if the word isn't there."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary))


class Matcher:
    """The notices as sets of ranks (0: the rarest word of all texts), with their prefixes."""

    def __init__(self, notices: dict[str, str], vocabulary: np.ndarray, counts: np.ndarray, threshold: float):
        order = np.lexsort((vocabulary, counts))
        self.vocabulary, self.rank = vocabulary, np.empty(len(vocabulary) + 1, dtype=np.int64)
        self.rank[order], self.rank[-1] = np.arange(len(vocabulary)), -1
        self.notices = []
        self.in_prefix = np.zeros(len(vocabulary) + 1, dtype=bool)
        for label in sorted(notices):
            hashes = _hashes(notices[label])
            ranks = np.unique(self.rank[_place(vocabulary, hashes)])
            if not len(ranks):
                continue
            need = math.ceil(threshold * len(ranks) - 1e-9)
            member = np.full(len(vocabulary) + 1, -1, dtype=np.int64)  # place in the notice's order; -1: no word of it
            member[ranks] = np.arange(len(ranks))
            self.in_prefix[ranks[: len(ranks) - need + 1]] = True
            self.notices.append((label, member, len(ranks), need, block_words(len(hashes))))

    def matches(self, ranks: np.ndarray):
        """(label, first word, last word + 1, containment) of the runs of blocks in a text that match a notice; ranks: -1 beyond the vocabulary."""
        for label, member, size, need, length in self.notices:
            places = member[ranks]  # rank -1 is the last entry, which is -1
            near = np.flatnonzero((places >= 0) & (places <= size - need))
            if not len(near):
                continue
            new = np.flatnonzero(np.r_[True, np.diff(near) >= 2 * length - 1])
            for s, e in zip(near[new].tolist(), near[np.r_[new[1:], len(near)] - 1].tolist()):
                s, e = max(0, s - length + 1), min(len(ranks), e + length)
                own = places[s:e]
                at = np.flatnonzero(own >= 0)
                if e - s < need or len(at) < need or size - own[at].min() < need:
                    continue
                # a word counts in the blocks that begin after its place before and at it at the latest
                order = np.lexsort((at, own[at]))
                before = np.full(len(at), -1)
                same = np.r_[False, own[at][order][1:] == own[at][order][:-1]]
                before[order[same]] = at[order[np.flatnonzero(same) - 1]]
                steps = np.bincount(np.maximum(np.maximum(before + 1, at - length + 1), 0), minlength=e - s + 1) - np.bincount(at + 1, minlength=e - s + 1)
                both = np.cumsum(steps)[: e - s]
                good = np.flatnonzero(both >= need)
                if not len(good):
                    continue
                cuts = np.flatnonzero(np.r_[True, np.diff(good) > 1])
                for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(good)]):
                    yield label, s + int(good[i]), min(s + int(good[j - 1]) + length, len(ranks)), float(both[good[i:j]].max()) / size


_MATCH = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])


def _scan(matcher, phrases: dict[str, str]):
    wanted = [(label, _hashes(p)) for p, label in phrases.items()]

    def run(batches):
        m = matcher.value
        for batch in batches:
            for first, offsets, data in chunks(batch.column(1)):
                data = lower(data)
                starts, ends, index = words(data, offsets, ALNUM_WORDS)
                h = hash_slices(data, starts, ends)
                n = len(offsets) - 1
                owner = np.repeat(np.arange(n), np.diff(index))
                places: list[list] = [[] for _ in range(n)]
                for label, phrase in wanted:
                    k = len(phrase)
                    if len(h) < k:
                        continue
                    hit = owner[: len(h) - k + 1] == owner[k - 1 :]
                    for i, x in enumerate(phrase):
                        hit &= h[i : len(h) - k + 1 + i] == x
                    for i in np.flatnonzero(hit).tolist():
                        places[owner[i]].append({"word": i - int(index[owner[i]]), "label": label})
                found: list[list] = [[] for _ in range(n)]
                if len(h):
                    rank = m.rank[_place(m.vocabulary, h)]
                    for d in np.unique(owner[(rank >= 0) & m.in_prefix[rank]]).tolist():
                        for label, begin, end, share in m.matches(rank[index[d] : index[d + 1]]):
                            found[d].append({"first": begin, "end": end, "label": label, "containment": share})
                yield pa.record_batch([batch.column(0).slice(first, n), pa.array(np.diff(index)), pa.array(places, pa.list_(_PLACE)), pa.array(found, pa.list_(_MATCH))], ["row", "n_words", "places", "matches"])

    return run


def license_matches(docs: DataFrame, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without text, with n_words, places (word, label: each place of a phrase) and matches (first, end, label, containment:
    words first .. end - 1 are blocks, each of which holds at least ``threshold`` of the notice's words; containment: the best one's)."""
    notices, phrases = NOTICES if notices is None else notices, PHRASES if phrases is None else phrases
    vocabulary = _vocabulary(notices)
    counts = np.zeros(len(vocabulary), dtype=np.int64)
    for r in docs.select("text").mapInArrow(tidy(_frequencies(vocabulary)), "place long, n long").groupBy("place").agg(F.sum("n")).collect():  # a row for each word of the notices
        counts[r[0]] = r[1]
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(notices, vocabulary, counts, threshold))
    named = docs.select(row_without(docs, "text", *RESULTS).alias("row"), "text")
    schema = f"row {kind_of(named, 'row')}, n_words long, places array<struct<word: long, label: string>>, matches array<struct<first: long, end: long, label: string, containment: double>>"
    return named.mapInArrow(tidy(_scan(matcher, phrases)), schema).select("row.*", *RESULTS)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    out = license_matches(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("places.label", "matches.label")), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIND = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LIST = ", ".join(f"({_quoted(k)}, {_quoted(v.lower())})" for k, v in NOTICES.items())
_PHRASE_LIST = ", ".join(f"({_quoted(v)}, {_quoted(k)})" for k, v in PHRASES.items())

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_LOW.format("coalesce(text, '')")} t FROM documents),
w AS (SELECT doc_id, t, {_FIND.format("t")} w FROM d),
p AS (SELECT label, phrase, len(string_split(phrase, ' ')) k FROM (VALUES {_PHRASE_LIST}) v(label, phrase)),
b AS (SELECT doc_id, label, i - 1 word FROM (SELECT doc_id, w, label, phrase, k, unnest(generate_series(1, len(w) - k + 1)) i FROM w, p WHERE len(w) >= k) WHERE array_to_string(w[i : i + k - 1], ' ') = phrase),
n AS (SELECT label, s, len(s) m, CAST(ceil({THRESHOLD} * len(s) - 1e-9) AS INTEGER) need, k + (k + 3) // 4 size FROM (SELECT label, list_distinct(v) s, len(v) k FROM (SELECT label, {_FIND.format("txt")} v FROM (VALUES {_LIST}) v(label, txt)))),
u AS (SELECT doc_id, w.w[i] word, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) i FROM w) w),
nw AS (SELECT label, m, need, size, unnest(s) word FROM n),
h AS (SELECT doc_id, label, m, need, size, i, lag(i, 1, 0) OVER (PARTITION BY doc_id, label, word ORDER BY i) b, count(DISTINCT word) OVER (PARTITION BY doc_id, label) every FROM u JOIN nw USING (word)),
st AS (SELECT doc_id, label, m, need, unnest(generate_series(greatest(b + 1, i - size + 1, 1), i)) s FROM h WHERE every >= need),
m AS (SELECT doc_id, label, count(*) / CAST(m AS DOUBLE) c FROM st GROUP BY doc_id, label, m, need, s HAVING count(*) >= need),
bb AS (SELECT doc_id, count(*) n_base, min(word) first_word, max(word) last_word, string_agg(DISTINCT label, ',' ORDER BY label) base_labels FROM b GROUP BY doc_id),
ll AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) labels FROM (SELECT DISTINCT doc_id, label FROM b UNION SELECT DISTINCT doc_id, label FROM m) GROUP BY doc_id),
mm AS (SELECT doc_id, max(c) c FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
       CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(mm.c, 0.0) END AS DOUBLE) score
FROM w LEFT JOIN bb ON bb.doc_id = w.doc_id LEFT JOIN ll ON ll.doc_id = w.doc_id LEFT JOIN mm ON mm.doc_id = w.doc_id
"""
