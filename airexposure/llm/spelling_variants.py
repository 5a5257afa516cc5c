"""Spelling variants: words one edit apart, each tied to the far more common one.

``counted``: runs of letters of whole texts, with the errors that a hash plants, to distinct words and their counts.
``near_words``: for each word the number of words one edit away and the most common of them. Two words one edit apart share
what stands before the edit and what stands after it, so words meet by (shorter length, range of places, what stands before
the range, what stands after it): PARTS ranges cover all places. Within such a group the words are sorted and each is held
against those after it by dynamic programming over prefixes: the rows of the edit matrix, three cells wide, that belong to
the prefix shared with the word before are used again, and where all cells of a row exceed one edit, the whole range of words
with that prefix is skipped. A group of more than BOUND words isn't scanned but halves its range of places; a range of one
place leaves one or two letters free, so its groups are as large as the alphabet and its square allow. Each pair counts
in the one range that holds its first differing place.
``rooted``: the chain of forms to its end by doubling; counts double along it, so it has no rings and is short.

Null and empty texts have no words; a null doc_id is written as nothing; repeated rows count each; the smallest word in the
order of code points wins among equal counts; an empty table gives no rows; words of any length are taken whole.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, buckets_for, materialize, read
from .textbytes import tidy

PARTS = 4  # ranges of places in which a pair may differ
BOUND = 2000  # words of a group that are scanned at once
LAST = "\U0010ffff"  # comes after all letters

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): distinct words of at least least_length characters and least_count places, planted errors included."""
    run = F.explode(F.expr(r"regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]+', 0)"))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), run.alias("_r"))
    low = runs.select("_d", F.translate("_r", CAPITALS, SMALL).alias("_r")).filter(F.length("_r") >= least_length)
    hashed = low.withColumn("_h", F.crc32(F.encode(F.concat("_d", F.lit(":"), "_r"), "UTF-8")))
    at = "cast(_h % length(_r) as int)"
    word = F.when(F.col("_h") % every == 0, F.expr(f"concat(substring(_r, 1, {at}), substring(_r, {at} + 2))")).otherwise(F.col("_r"))
    words = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _row_after(row: tuple[int, int, int], depth: int, sign: str, query: str) -> tuple[int, int, int]:
    """The row of the edit matrix one sign further: edits between depth + 1 signs of the word and depth, depth + 1, depth + 2 of the query."""
    left, middle, right = row
    n = len(query)
    # beyond the query's ends there is nothing to reach
    a = min(left + (sign != query[depth - 1]), middle + 1) if 0 < depth <= n else middle + 1 if depth <= n else 2
    b = min(middle + (sign != query[depth]), right + 1, a + 1) if depth < n else 2
    c = min(right + (sign != query[depth + 1]), b + 1) if depth + 1 < n else 2
    return a, b, c


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def scan(words: list[str], start: int = 0):
    """Pairs (i, j), i < j, of the sorted distinct words one edit apart; all share their first ``start`` signs."""
    lcp = [start] + [_shared(a, b) for a, b in zip(words, words[1:])]
    for i, query in enumerate(words):
        rows = [(1, 0, 1)]  # the row at depth start + k, of the word last looked at
        j, keep = i + 1, start
        while j < len(words):
            word = words[j]
            keep = min(keep, lcp[j]) if j > i + 1 else lcp[j]
            if keep < start + len(rows) - 1:
                del rows[keep - start + 1 :]
            depth, row = start + len(rows) - 1, rows[-1]
            while depth < len(word) and min(row) <= 1:
                row = _row_after(row, depth, word[depth], query)
                rows.append(row)
                depth += 1
            if min(row) > 1:
                # what shares this prefix is as far
                rows.pop()
                keep = depth - 1
                j = bisect_left(words, word[:depth] + LAST, j + 1)
                continue
            if abs(len(query) - len(word)) <= 1 and row[len(query) - len(word) + 1] == 1:
                yield i, j
            keep = len(word)
            j += 1


_FOUND = "word string, n long, n_near long, form_n long, form string, _a int, _b int, _m int"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [x.split()[0] for x in _FOUND.split(", ")])


def _best(held: list[tuple[str, int]], a: int, b: int, m: int) -> list[tuple]:
    """The words (word, n) of a sorted group that have near words in it, with their number and the most common of them."""
    words = [w for w, _ in held]
    near, best = [0] * len(words), [None] * len(words)
    # groups are told apart by a hash; where two meet by chance, less is shared
    for i, j in scan(words, min(a, _shared(words[0], words[-1]))):
        u, v = words[i], words[j]
        if min(len(u), len(v)) != m or not a <= _shared(u, v) < b:
            continue  # counted with other lengths or in another range
        for x, y in ((i, j), (j, i)):
            near[x] += 1
            if best[x] is None or (-held[y][1], words[y]) < best[x]:
                best[x] = (-held[y][1], words[y])
    return [(w, n, k, -top[0], top[1], a, b, m) for (w, n), k, top in zip(held, near, best) if k]


def _scanned(bound: int):
    """Groups (_key, _a, _b, _m, word, n), sorted by all but n, to near words; groups of more than ``bound`` words come back without results."""

    def rows(batches):
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def run(batches):
        out = []
        for (_, a, b, m), group in groupby(rows(batches), key=itemgetter(0, 1, 2, 3)):
            held = []
            for r in group:
                held.append(r[4:])
                if len(held) > bound and b - a > 1:
                    for w, n in chain(held, map(itemgetter(4, 5), group)):
                        out.append((w, n, None, None, None, a, b, m))
                        if len(out) >= 10_000:
                            yield _batch(out)
                            out = []
                    held = []
            if len(held) > 1:
                out += _best(held, a, b, m)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def near_words(words: DataFrame, bound: int = BOUND) -> DataFrame:
    """words (word, n), distinct, to (word, n_near, form_n, form): how many words are one edit away, and the most common; only words that have any."""
    spark = words.sparkSession
    bounded_batches(spark)
    # lengths of the shorter of a pair: the word's own and one less; places of edits: 0 to that length
    both = words.select("word", "n", F.explode(F.expr("filter(array(length(word), length(word) - 1), x -> x > 0)")).alias("_m"))
    ranges = F.expr(f"filter(transform(sequence(0, {PARTS - 1}), k -> named_struct('a', cast(k * (_m + 1) div {PARTS} as int), 'b', cast((k + 1) * (_m + 1) div {PARTS} as int))), r -> r.a < r.b)")
    todo = both.withColumn("_r", F.explode(ranges)).select("word", "n", "_m", F.col("_r.a").alias("_a"), F.col("_r.b").alias("_b"))
    found = None
    while True:
        key = F.expr("xxhash64(_m, _a, _b, substring(word, 1, _a), right(word, greatest(_m - _b, 0)))")
        groups = todo.select(key.alias("_key"), "_a", "_b", "_m", "word", "n")
        sorted_ = groups.repartition(buckets_for(spark), "_key").sortWithinPartitions("_key", "_a", "_b", "_m", "word")
        done = materialize(sorted_.mapInArrow(tidy(_scanned(bound)), _FOUND), "near")
        here = done.filter("n_near is not null").select("word", "n_near", "form_n", "form")
        found = here if found is None else found.unionByName(here)
        large = done.filter("n_near is null")
        if not large.head(1):
            break
        halves = F.array(F.struct(F.col("_a").alias("a"), F.expr("cast((_a + _b) div 2 as int)").alias("b")), F.struct(F.expr("cast((_a + _b) div 2 as int)").alias("a"), F.col("_b").alias("b")))
        todo = large.withColumn("_r", F.explode(halves)).select("word", "n", "_m", F.col("_r.a").alias("_a"), F.col("_r.b").alias("_b"))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w"))).alias("_best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("_best.n")).alias("form_n"), F.col("_best.w").alias("form"))


def rooted(forms: DataFrame) -> DataFrame:
    """forms (word, form) of words that have a form, to (word, root): the end of each chain."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.alias("a").join(now.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        now = materialize(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if not now.filter("_moved").head(1):
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, times: int = 2, bound: int = BOUND) -> DataFrame:
    """words (word, n) to (word, n, n_near, form, form_n, root): a form is the most common near word, if at least ``times`` as common."""
    near = materialize(words.join(near_words(words, bound), "word", "left"), "variants")
    good = F.col("form_n") >= times * F.col("n")
    all_ = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    roots = rooted(all_.filter("form is not null"))
    return all_.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    words = materialize(counted(read(spark, sf_dir, "documents").select("doc_id", "text")), "words")
    return variants(words)
