"""Benchmark decontamination with a distributed positional inverted index.

``postings`` stores, for each block of training texts, every distinct term and the ascending positions at which it stands
(terms are 64-bit word hashes; positions run through the texts of the block, with a gap between texts). The index is
written out once, whatever is asked of it; its blocks follow Spark's partitions of the texts, so building it shuffles
nothing and each block is bounded by the block size.

``phrase_hits`` sends the benchmark's windows to the stored blocks and, for each window, starts from the postings of its
term that is rarest in the block, shifts them by the term's offset, and intersects with the other terms' shifted postings
in order of rarity. The benchmark is dealt into parts of about ``PART_WORDS`` words by hash; one part at a time passes
through the driver to the tasks, so what is broadcast has a fixed size whatever the benchmark's. A text's hits from all
parts meet by its place in the index. ``proximity_hits`` finds places where all terms stand within a number of words.

Null texts have no words; a text without words has no hits; items without words are ignored; repeated items and repeated
rows are treated one by one, rows being told apart by their place in the index, so doc_id may repeat or be null; a null
item_id marks words but is not listed. Columns of the texts that are called like results go; ``drop_contaminated`` keeps all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, kind_of, materialize, read, row_without
from .textbytes import ALNUM_WORDS, chunks, hash_slices, lower, tidy, words

PART_WORDS = 1 << 18  # benchmark words that are sent to the tasks at once
INDEX_BYTES = 4 << 20  # text bytes indexed together
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated")
_FOUND = "block long, nth int, hits array<struct<s: long, e: long>>, items array<string>"


def _terms(data: np.ndarray, offsets: np.ndarray):
    data = lower(data)
    starts, ends, index = words(data, offsets, ALNUM_WORDS)
    return hash_slices(data, starts, ends), index


def _index(batches):
    """Arrow function: (row, text) to one row for each block of texts: rows, word counts and postings."""
    for batch in batches:
        for first, offsets, data in chunks(batch.column(1), INDEX_BYTES):
            terms, index = _terms(data, offsets)
            n = len(offsets) - 1
            counts = np.diff(index)
            # positions leave a gap of one between texts, so no phrase crosses
            place = np.arange(len(terms)) + np.repeat(np.arange(n), counts)
            order = np.argsort(terms, kind="stable")
            distinct, begin = np.unique(terms[order], return_index=True)
            one = [0, n]
            yield pa.record_batch(
                [
                    pa.ListArray.from_arrays(pa.array(one, pa.int32()), batch.column(0).slice(first, n)),
                    pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.array(counts.astype(np.int64))),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (distinct, np.r_[begin, len(terms)].astype(np.int64), place[order].astype(np.int64))),
                ],
                ["rows", "counts", "terms", "begins", "positions"],
            )


def postings(docs: DataFrame) -> DataFrame:
    """The stored positional index of docs.text: a row for each block, with its texts' other columns."""
    named = docs.select(row_without(docs, "text", *RESULTS, "hits").alias("row"), "text")
    found = named.mapInArrow(tidy(_index), f"rows array<{kind_of(named, 'row')}>, counts array<long>, terms binary, begins binary, positions binary")
    return materialize(found.withColumn("block", F.monotonically_increasing_id()), "postings", "zstd", large_rows=True)


class Block:
    """One row of the index."""

    def __init__(self, counts: np.ndarray, terms: bytes, begins: bytes, positions: bytes):
        self.counts, self.terms = counts, np.frombuffer(terms, np.uint64)
        self.begins, self.positions = np.frombuffer(begins, np.int64), np.frombuffer(positions, np.int64)
        self.first = np.cumsum(self.counts + 1) - self.counts - 1  # position of each text's first word

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the block's dictionary; -1: not there."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def lists(self, at: np.ndarray) -> np.ndarray:
        return self.begins[at + 1] - self.begins[at]

    def list(self, at: int) -> np.ndarray:
        return self.positions[self.begins[at] : self.begins[at + 1]]

    def phrase(self, at: np.ndarray) -> np.ndarray:
        """Positions at which the terms (places in the dictionary) stand one after the other."""
        order = np.argsort(self.lists(at), kind="stable")
        starts = self.list(int(at[order[0]])) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.list(int(at[k]))
            to = np.searchsorted(other, starts + k)
            starts = starts[(to < len(other)) & (other[np.minimum(to, len(other) - 1)] == starts + k)]
        return starts

    def near(self, at: np.ndarray, span: int) -> np.ndarray:
        """Positions p of the rarest term for which every other term stands within span - 1 words of p, on one side or the other,
        so that all fit into ``span`` words that hold p; the intersection starts from the rarest list."""
        order = np.argsort(self.lists(at), kind="stable")
        center, found = self.list(int(at[order[0]])), []
        for p in center.tolist():
            text = int(np.searchsorted(self.first, p, side="right")) - 1
            low, high = max(p - span + 1, int(self.first[text])), min(p + span, int(self.first[text] + self.counts[text]))
            near = []
            for k in order[1:]:
                other = self.list(int(at[k]))
                near.append(other[np.searchsorted(other, low) : np.searchsorted(other, high)])
                if not len(near[-1]):
                    break
            if all(map(len, near)) and any(all(len(x) and np.searchsorted(x, s) < np.searchsorted(x, s + span) for x in near) for s in range(low, p + 1) if s + span > p):
                found.append(p)
        return np.array(found, dtype=np.int64)


def _merged(hits: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(hits):
        if out and s <= out[-1]["e"]:
            out[-1]["e"] = max(e, out[-1]["e"])
        else:
            out.append({"s": s, "e": e})
    return out


def _search(queries, width: int, span: int | None):
    """Arrow function over the index: one row for each text with hits: its place, covered words as starts and ends, items.

    queries: broadcast list of (item, terms). Hits of a phrase that touch are one run; those of proximity stay single words.
    """

    def run(batches):
        for batch in batches:
            number, counts = batch.column("block").to_pylist(), batch.column("counts")
            for i, parts in enumerate(zip(*(batch.column(k).to_pylist() for k in ("terms", "begins", "positions")))):
                block = Block(counts[i].values.to_numpy(), *parts)
                hits: dict[int, list] = {}
                for item, terms in queries.value:
                    at = block.find(terms)
                    size = len(terms) if span else min(width, len(terms))
                    good = np.r_[0, np.cumsum(at >= 0)]
                    for k in np.flatnonzero(good[size:] - good[:-size] == size):
                        found = block.near(np.unique(at), span) if span else block.phrase(at[k : k + size])
                        for p in found.tolist():
                            text = int(np.searchsorted(block.first, p, side="right")) - 1
                            start = p - int(block.first[text])
                            hits.setdefault(text, []).append((start, start + (1 if span else size), item))
                if hits:
                    spans = [[{"s": s, "e": e} for s, e, _ in sorted(set(h))] if span else _merged([x[:2] for x in h]) for h in hits.values()]
                    items = [sorted({x[2] for x in h if x[2] is not None}) for h in hits.values()]
                    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                    yield pa.record_batch([pa.array([number[i]] * len(hits), pa.int64()), pa.array(list(hits), pa.int32()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["block", "nth", "hits", "items"])

    return run


def _of_items(rows) -> list[tuple[str | None, np.ndarray]]:
    """(item_id, terms) of items (item_id, text)."""
    out = []
    for item, text in rows:
        terms = [_terms(data, offsets)[0] for _, offsets, data in chunks(pa.array([text], pa.string()))]
        if len(terms) and len(terms[0]):
            out.append((item, terms[0]))
    return out


def _hits(index: DataFrame, items: DataFrame, width: int, span: int | None) -> DataFrame:
    """(block, nth, hits, items), a row for each text with hits and part of the benchmark; parts are searched one after the other."""
    context = index.sparkSession.sparkContext
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    # a word takes two bytes at least
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0] // 2
    parts = 1 + total // PART_WORDS
    named = named.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    found = []
    for k in range(parts):
        queries = context.broadcast(_of_items(named.filter(F.col("part") == k).select("item_id", "text").toLocalIterator()))
        search = index.select("block", "counts", "terms", "begins", "positions").mapInArrow(tidy(_search(queries, width, span)), _FOUND)
        found.append(materialize(search, "hits"))
        queries.unpersist()
    return reduce(DataFrame.unionByName, found)


def phrase_hits(index: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """(block, nth, hits, items): where windows of ``width`` consecutive words of items(item_id, text) stand; a shorter item is one window."""
    return _hits(index, items, width, None)


def proximity_hits(index: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """(block, nth, hits, items): places of each item's rarest term where all its distinct terms stand within ``span`` words."""
    return _hits(index, items, 0, span)


def by_text(index: DataFrame, found: DataFrame) -> DataFrame:
    """(row, n_words, hits, items) of every text of the index; hits and items are empty without any."""
    every = index.select("block", F.posexplode(F.arrays_zip("rows", "counts")).alias("nth", "z")).select("block", "nth", F.col("z.rows").alias("row"), F.col("z.counts").alias("n_words"))
    each = found.groupBy("block", "nth").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = every.join(each, ["block", "nth"], "left")
    none = F.from_json(F.lit("[]"), "array<struct<s: long, e: long>>")
    return out.select("row", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """All columns of docs but ``text``, with n_words, n_hit, n_items, items_sha256, items and contaminated.

    A word is hit if it lies in a place where ``width`` consecutive words of an item stand; a text is contaminated if at
    least one word in twenty is hit.
    """
    index = postings(docs)
    found = by_text(index, phrase_hits(index, benchmark, width))
    step = "named_struct('n', a.n + greatest(0L, h.e - greatest(h.s, a.at)), 'at', greatest(a.at, h.e))"
    covered = F.expr(f"aggregate(array_sort(hits), named_struct('n', 0L, 'at', 0L), (a, h) -> {step}, a -> a.n)")
    out = found.withColumn("n_hit", covered).withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select("row.*", *RESULTS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """docs without the contaminated texts, all columns kept; which texts those are follows from the texts alone."""
    h, g = free_names(docs, "_h", "_g")
    keys = {h: F.xxhash64("text"), g: F.xxhash64(F.lit(7), "text")}
    bad = contamination(docs.select("text", *[v.alias(k) for k, v in keys.items()]), benchmark, width)
    bad = materialize(bad.filter("contaminated").select(h, g).distinct(), "contaminated")
    return docs.withColumns(keys).join(bad, [h, g], "left_anti").select(*docs.columns)


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
i AS (SELECT item_id, {_WORDS} w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(w)) k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') g
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM q),
g AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') g
      FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) p FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT g.doc_id, g.p, g.k, q.item_id FROM g JOIN q ON g.k = q.k AND g.g = q.g),
hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) p FROM (SELECT DISTINCT doc_id, p, k FROM h)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, coalesce(hit.n_hit, 0) n_hit, coalesce(its.n_items, 0) n_items, sha256(coalesce(its.s, '')) items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
