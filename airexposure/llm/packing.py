"""Best-fit packing of tokenised documents into fixed-length sequences, planned on the length histogram.

1. ``tokenize``: documents to token ids plus an end id; only longer ones are cut into full pieces and a rest.
2. ``plan``: best-fit decreasing over (length, count) pairs. Open sequences with the same room left are one class, held
   as ranges of sequence numbers, so the plan's size depends on the number of lengths, never on that of the documents.
3. ``pack``: each piece gets a rank within its length (hot lengths are numbered in parts) and takes the slot that the
   plan gives that rank, by an equi-join on length with a range test. Only digests are ranked; the ids join the places last.

A null text is empty (its one token is the end id); empty and repeated rows get pieces of their own; ties in rank are
broken by doc_id, piece, checksum and, where ids are kept, the piece's number in the written table, so a task that is repeated
gives no slot twice; an empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, gapless_rank, materialize, read
from .textbytes import chunks, hash_slices, lower, tidy, words

CACHE = 150_000  # distinct pieces of text whose ids a task keeps
PORTION = 8192  # of them tokenised at once

_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[0x20, 9, 10, 13]] = False
# classes of bytes: 1 letters, 2 digits, 3 other ASCII signs; 0: anything whose neighbours could matter
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x27] = 0


def _spans(data: np.ndarray, offsets: np.ndarray):
    """Text split where the tokenizer's own pre-tokenizer always splits: (bytes to tokenise, starts, ends, first piece of each text, whole).

    Between white space, runs of letters (ASCII and U+00C0..U+024F but for three), single digits and runs of other signs
    are pieces of their own; words that hold anything else (apostrophes, marks, other scripts, "<|") stay whole.
    """
    kind = _CLASS[data]
    follow = np.r_[data[1:], np.uint8(0)]
    lead = (data >= 0xC3) & (data <= 0xC9) & (follow >= 0x80) & (follow < 0xC0)
    lead &= ~((data == 0xC3) & ((follow == 0x97) | (follow == 0xB7))) & ~((data == 0xC4) & (follow == 0xB0))
    kind[lead] = 1
    kind[1:][lead[:-1]] = 1
    kind[(data == 0x3C) & (follow == 0x7C)] = 0
    starts, ends, index = words(data, offsets, _NOT_SPACE)
    if not len(starts):
        return data, starts, ends, index, np.zeros(0, dtype=bool)
    odd = np.r_[0, np.cumsum(kind == 0)]
    whole = odd[ends] > odd[starts]
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[whole]] += 1
    edge[ends[whole]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    kind[inside] = 9
    out = np.where(inside, data, lower(data))
    space = ~_NOT_SPACE[data]
    kind[space] = 8
    first = np.r_[True, kind[1:] != kind[:-1]] | (kind == 2)
    first[starts] = True
    last = np.r_[first[1:], True]
    last[ends - 1] = True
    begin = np.flatnonzero(first & ~space)
    end = np.flatnonzero(last & ~space) + 1
    return out, begin, end, np.searchsorted(begin, offsets), kind[begin] == 9


class _Vocabulary:
    """Ids of pieces of text, by their hash; made by each task, so that idle workers hold neither tokenizer nor ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for pieces that the normaliser would only put in lower case and the pre-tokenizer would not split
        self.plain = Tokenizer(self.tokenizer.model)  # the same vocabulary in memory
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self):
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = array("q", [0])

    def look_up(self, hashes: np.ndarray, whole: np.ndarray, slices) -> np.ndarray:
        """Places of the pieces; slices(missing) gives their strings; whole: pieces that need the full tokenizer."""
        if len(self.known) > CACHE:
            self.clear()
        known = self.known
        at = [known.get(h, -1) for h in hashes.tolist()]
        missing = np.flatnonzero(np.array(at, dtype=np.int64) < 0)
        missing = np.r_[missing[~whole[missing]], missing[whole[missing]]]
        for k in range(0, len(missing), PORTION):
            some = missing[k : k + PORTION]
            plain = int((~whole[some]).sum())
            strings = slices(some)
            lists = [strings[i : min(i + 256, plain)] for i in range(0, plain, 256)]
            self._keep(lists, self.plain.encode_batch([" ".join(x).lower() for x in lists], add_special_tokens=False))
            lists = [strings[i : i + 256] for i in range(plain, len(strings), 256)]
            self._keep(lists, self.tokenizer.encode_batch(lists, is_pretokenized=True, add_special_tokens=False))
        for n, i in enumerate(missing.tolist(), len(self.ends) - 1 - len(missing)):
            at[i] = known[int(hashes[i])] = n
        return np.array(at, dtype=np.int64)

    def _keep(self, lists, encodings):
        for strings, enc in zip(lists, encodings):
            ids = np.array(enc.ids, dtype=np.uint32)
            counts = np.bincount(np.array(enc.word_ids, dtype=np.int64), minlength=len(strings)) if len(ids) else np.zeros(len(strings), np.int64)
            end = self.ends[-1]
            while end + len(ids) > len(self.ids):
                self.ids = np.r_[self.ids, np.zeros(len(self.ids), dtype=np.uint32)]
            self.ids[end : end + len(ids)] = ids
            self.ends.extend((end + np.cumsum(counts)).tolist())


def _encode(vocabulary: _Vocabulary, data: np.ndarray, offsets: np.ndarray, end_id: int):
    """(ids of all texts, each followed by the end id, and where each text's ids begin)."""
    out, starts, ends, index, whole = _spans(data, offsets)
    n = len(offsets) - 1
    distinct, first, inverse = np.unique(hash_slices(out, starts, ends), return_index=True, return_inverse=True)
    raw = out.tobytes()
    places = vocabulary.look_up(distinct, whole[first], lambda m: [raw[s:e].decode() for s, e in zip(starts[first[m]].tolist(), ends[first[m]].tolist())]) if len(distinct) else np.zeros(0, np.int64)
    stops = np.array(vocabulary.ends, dtype=np.int64)
    begin, size = stops[places][inverse], (stops[places + 1] - stops[places])[inverse]
    sums = np.r_[0, np.cumsum(size)]
    ids_before = sums[index]  # ids before each text, without end ids
    at = ids_before + np.arange(n + 1)
    flat = np.full(int(at[-1]), end_id, dtype="<u4")
    keep = np.ones(len(flat), dtype=bool)
    keep[at[1:] - 1] = False
    flat[keep] = vocabulary.ids[np.arange(int(sums[-1])) + np.repeat(begin - sums[:-1], size)]
    return flat, at


def _pieces(path: str, length: int, end_id: int, keep_ids: bool):
    def run(batches):
        vocabulary = _Vocabulary(path)
        for batch in batches:
            for first, offsets, data in chunks(batch.column(1)):
                flat, at = _encode(vocabulary, data, offsets, end_id)
                rows, piece, start, size, crc, begin = [], [], [], [], [], []
                for d, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    for k, p in enumerate(range(s, e, length)):
                        part = flat[p : min(e, p + length)]
                        rows.append(first + d)
                        piece.append(k)
                        start.append(p - s)
                        size.append(len(part))
                        crc.append(zlib.crc32(part))
                        begin.append(p)
                cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    # the pieces follow one another without gaps
                    cols.append(pa.ListArray.from_arrays(pa.array([*begin, len(flat)], pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(cols, names)

    return run


def tokenize(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each text's ids; ``path``: a tokenizers file."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(_pieces(path, length, end_id, keep_ids)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset, pieces per sequence) of best-fit decreasing over counts.

    Rank r of a length takes sequence first + (r - first rank) // per at offset + length * ((r - first rank) % per).
    """
    out, room, open_ = [], [], {}  # room: sorted rooms left; open_: room -> ranges of sequences
    used = 0

    def put(left: int, start: int, n: int) -> None:
        if left and n:
            if left not in open_:
                insort(room, left)
                open_[left] = []
            open_[left].append((start, n))

    for size in sorted(histogram, reverse=True):
        rank, count = 0, histogram[size]
        while rank < count and (k := bisect_left(room, size)) < len(room):
            left = room[k]
            start, n = open_[left].pop()
            if not open_[left]:
                del open_[left], room[k]
            take = min(n, count - rank)
            out.append((size, rank, rank + take, start, capacity - left, 1))
            rank += take
            put(left - size, start, take)
            put(left, start + take, n - take)
        if rank < count:
            per = capacity // size
            full, rest = divmod(count - rank, per)
            if full:
                out.append((size, rank, rank + full * per, used, 0, per))
                put(capacity - per * size, used, full)
                used, rank = used + full, rank + full * per
            if rest:
                out.append((size, rank, rank + rest, used, 0, per))
                put(capacity - rest * size, used, 1)
                used += 1
    return out


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError("piece lengths must be from 1 to the capacity")
    # about ten rows of plan for a length, bounded by the number of lengths
    rows = plan(histogram, capacity)
    slots = pieces.sparkSession.createDataFrame(rows, "_length long, _from long, _to long, _sequence long, _offset long, _per long") if rows else pieces.sparkSession.createDataFrame([], "_length long, _from long, _to long, _sequence long, _offset long, _per long")
    # pieces equal in all of these are alike in their results too; a repeated task gives all others the same ranks
    order = ["doc_id", "piece", *[c for c in ("ids_crc32", "_piece") if c in pieces.columns]]
    ranked = gapless_rank(pieces, ["length"], order, "_rank", buckets_for(pieces.sparkSession))
    match = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(slots), match)
    step = F.col("_rank") - F.col("_from")
    return placed.select(*pieces.columns, (F.col("_sequence") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.col("length") * (step % F.col("_per"))).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) to packed pieces, with their ids unless only the digests are wanted."""
    if not keep_ids:
        return pack(materialize(tokenize(docs, path, capacity, end_id, False), "pieces"), capacity)
    # the number is written with the piece, so it stays the same; doc_id and piece may repeat
    pieces = materialize(tokenize(docs, path, capacity, end_id).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.drop("ids"), capacity).join(pieces.select("_piece", "ids"), "_piece")
    return placed.select(*[c for c in pieces.columns if c != "_piece"], "sequence_id", "offset")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary_path(), 4096, keep_ids=False)
