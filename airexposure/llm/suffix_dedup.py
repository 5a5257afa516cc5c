"""Exact substring dedup: every byte inside a string of ``length`` bytes that also starts elsewhere is removed.

Method: not prefix doubling proper, which ranks every byte position by sorted (rank, rank at an offset) pairs and would move
many times the corpus, but what it does to ranks, at positions chosen by content: the anchor of a window of ``length``
bytes is the leftmost of its 16-byte strings with the smallest hash. Equal windows have equal anchors at equal
offsets, so a window repeats only if its anchor's surroundings do. Ranks are hash classes of strings, without an order; they
are refined at three growing lengths:

1. about 108 bytes around each anchor (all windows whose anchor offset lies in one half of the range share them);
   anchors whose string is unique are done, anchors whose whole surroundings repeat are removed at once;
2. of the rest one representative per distinct surroundings stays, and is ranked again at 188 bytes (cells of 12
   window starts), again dropping what is unique;
3. what is left is ranked at the full ``length``.

No group is ever gathered: each step is a count (combined before the shuffle) and an equi-join that Spark can split
where one string is very frequent. Only the repeated positions, not the texts, meet each other.

Which bytes of a text repeat follows from the texts alone, so texts, not rows, have identities: 80 bits of hashes.

Nulls are empty texts; texts shorter than ``length`` lose nothing; repeated rows count as different texts, so a row
that is there twice loses all bytes if it is long enough; doc_id may repeat, be null or be of any type, and is not read.
Of other columns, those called like the results go in ``remove_repeats``; ``without_repeats`` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, materialize, read, row_without
from .textbytes import _TABLE, chunks, tidy

K = 16  # bytes of the strings that anchors are chosen by
FINE = 12  # window starts in a cell of the second step
SEGMENT = 1 << 18  # bytes scanned at once; longer texts are scanned in overlapping segments
_B = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(4)]
_POS = np.uint64((1 << 20) - 1)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(anchor, least offset, largest offset) of the windows inside the texts; offset: anchor minus window start."""
    n, span = len(data), length - K + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    h = _TABLE[data]
    for i, b in enumerate(_B):
        step = 1 << i
        h = h[:-step] * b + h[step:]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= ~_POS
    h |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if span > width:
        h = np.minimum(h[: width - span], h[span - width :])
    h &= _POS
    inside = np.ones(n + 1, dtype=np.int8)
    for e in offsets[1:]:  # windows that cross the end of a text
        inside[max(0, e - length + 1) : e] = 0
    at = np.flatnonzero(inside[: len(h)])
    if not len(at):
        return none, none, none
    a = h[at].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[new[1:], len(at)] - 1
    return a[new], a[new] - at[last], a[new] - at[new]


def _segments(column: pa.Array, length: int):
    """(row, start in its text, offsets, bytes): whole texts together, or one segment of a long text."""
    for first, offsets, data in chunks(column, SEGMENT):
        if len(offsets) == 2 and len(data) > SEGMENT:
            for s in range(0, len(data) - length + 1, SEGMENT - length + 1):
                part = data[s : s + SEGMENT]
                yield first, s, np.array([0, len(part)]), part
        else:
            yield first, 0, offsets, data


def _halves(length: int) -> int:
    return (length - K + 2) // 2


def _scan(length: int, keys_only: bool):
    """Arrow function: (_d, _r, text) to ranked anchors. at packs position, half, offsets and _r into a long."""
    half = _halves(length)

    def run(batches):
        for batch in batches:
            d, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, shift, offsets, data in _segments(batch.column(2), length):
                a, low, high = _anchors(data, offsets, length)
                if not len(a):
                    continue
                own = first + np.searchsorted(offsets, a, side="right") - 1
                pos = a - offsets[own - first] + shift
                raw, x = data.tobytes(), xxhash.xxh3_64_intdigest
                key, whole, at, doc = [], [], [], []
                for part in (0, 1):
                    sel = np.flatnonzero(low < half) if part == 0 else np.flatnonzero(high >= half)
                    p = a[sel]
                    if part == 0:
                        lo, hi = low[sel], np.minimum(high[sel], half - 1)
                        key += [x(raw[i : i + length - half + 1]) for i in p.tolist()]
                    else:
                        lo, hi = np.maximum(low[sel], half), high[sel]
                        key += [x(raw[i - half : i + K], 1) for i in p.tolist()]
                    if keys_only:
                        continue
                    seed = lo * 256 + hi
                    whole += [x(raw[i:j], k) for i, j, k in zip((p - hi).tolist(), (p - lo + length).tolist(), seed.tolist())]
                    doc.append(d[own[sel]])
                    at.append((pos[sel] << 33) | (part << 32) | (lo << 24) | (hi << 16) | r[own[sel]])
                key = np.array(key, dtype=np.uint64).view(np.int64)
                if keys_only:
                    yield pa.record_batch([pa.array(key)], ["k"])
                else:
                    yield pa.record_batch([pa.array(key), pa.array(np.array(whole, dtype=np.uint64).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(at))], ["k", "u", "d", "at"])

    return run


def _contexts(length: int):
    """Arrow function: texts with their representatives to one row for each with the bytes around its anchor."""

    def run(batches):
        for batch in batches:
            text, reps, d = (batch.column(n).to_pylist() for n in ("text", "reps", "_d"))
            k, at, one, ctx, doc = [], [], [], [], []
            for t, rs, own in zip(text, reps, d):
                raw = t.encode()
                for x in rs:
                    a = x["at"]
                    p = a >> 33
                    k.append(x["k"])
                    at.append(a)
                    one.append(x["one"])
                    doc.append(own)
                    ctx.append(raw[p - ((a >> 16) & 255) : p - ((a >> 24) & 255) + length])
            yield pa.record_batch([pa.array(k, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(one, pa.bool_()), pa.array(ctx, pa.binary())], ["k", "d", "at", "one", "ctx"])

    return run


def _cells(length: int, width: int):
    """Arrow function: surroundings (k, d, at, one, ctx, lo, hi) to cells of ``width`` window starts.

    k2 ranks the bytes that all windows of a cell share, u2 all bytes of the own windows. ctx starts at the largest
    offset in ``at``; lo and hi bound the offsets looked at.
    """
    x = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            k2, u2, rows, los, his = [], [], [], [], []
            at, ctx, low, high = (batch.column(n).to_pylist() for n in ("at", "ctx", "lo", "hi"))
            for i, (a, c, lo0, hi0) in enumerate(zip(at, ctx, low, high)):
                base = (a >> 16) & 255
                for cell in range(lo0 // width, hi0 // width + 1):
                    first, last = cell * width, cell * width + width - 1
                    lo, hi = max(lo0, first), min(hi0, last)
                    key = x(c[base - first : base - last + length], cell)
                    k2.append(key)
                    u2.append(x(c[base - hi : base - lo + length], (cell * 256 + lo) * 256 + hi) if width > 1 else key)
                    rows.append(i)
                    los.append(lo)
                    his.append(hi)
            take = pa.array(rows, pa.int64())
            unsigned = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
            yield pa.record_batch([batch.column("k").take(take), unsigned(k2), unsigned(u2), batch.column("d").take(take), batch.column("at").take(take), batch.column("one").take(take), pa.array(los, pa.int32()), pa.array(his, pa.int32())], ["k", "k2", "u2", "d", "at", "one", "lo", "hi"])

    return run


def _remove(batches):
    """Arrow function: (_row, text, spans) to the kept bytes and counts; spans are starts << 32 | ends."""
    for batch in batches:
        kept, text, size, gone, runs = [], [], [], [], []
        for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = t.encode()
            parts, at, n = [], 0, 0
            for v in sorted(s or ()):
                lo, hi = v >> 32, v & 0xFFFFFFFF
                if n and lo <= at:
                    at = max(at, hi)
                else:
                    parts.append(raw[at:lo])
                    at, n = hi, n + 1
            parts.append(raw[at:])
            out = b"".join(parts)
            kept.append(out)
            text.append(out.decode("utf-8", "ignore"))
            size.append(len(raw))
            gone.append(len(raw) - len(out))
            runs.append(n)
        yield pa.record_batch([batch.column("_row"), pa.array(kept, pa.binary()), pa.array(text, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], ["_row", "kept", "kept_text", "n_bytes", "n_removed", "n_spans"])


def _spans(texts: DataFrame, length: int) -> DataFrame:
    """texts (_d, _r, text; one row for each place where a text stands) to (_d, _r, spans) of those with repeats."""
    counts = texts.mapInArrow(tidy(_scan(length, True)), "k long").groupBy("k").count().filter("count > 1").select("k")
    same = materialize(texts.mapInArrow(tidy(_scan(length, False)), "k long, u long, d long, at long").join(counts, "k"), "repeated-anchors")

    classes = same.groupBy("k", "u").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "at")).alias("rep"))
    whole = same.join(classes.filter("c > 1").select("k", "u"), ["k", "u"], "left_semi").selectExpr("d", "at", "cast(shiftright(at, 24) & 255 as int) lo", "cast(shiftright(at, 16) & 255 as int) hi")
    # written out, so that the join by k has nothing but the join above its exchanges and Spark can split a frequent k
    mixed = materialize(classes.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).filter("n > 1 and least = 1").select("k"), "mixed-anchors")
    reps = classes.join(mixed, "k").selectExpr("rep.d _d", "rep.at & 65535 _r", "struct(k, rep.at, c = 1 one) rep").groupBy("_d", "_r").agg(F.collect_list("rep").alias("reps"))
    once = texts.groupBy("_d", "_r").agg(F.first("text").alias("text"))
    ctx = materialize(once.join(reps, ["_d", "_r"]).mapInArrow(tidy(_contexts(length)), "k long, d long, at long, one boolean, ctx binary"), "surroundings")

    cell = "k long, k2 long, u2 long, d long, at long, one boolean, lo int, hi int"
    coarse = ctx.selectExpr("*", "cast(shiftright(at, 24) & 255 as int) lo", "cast(shiftright(at, 16) & 255 as int) hi").mapInArrow(tidy(_cells(length, FINE)), cell)
    classes2 = coarse.groupBy("k", "k2", "u2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "at", "lo", "hi", "one")).alias("rep"))
    whole2 = coarse.filter("one").join(classes2.filter("c > 1").select("k", "k2", "u2"), ["k", "k2", "u2"], "left_semi").select("d", "at", "lo", "hi")
    mixed2 = classes2.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("c = 1 and rep.one")).alias("any")).filter("n > 1 and any").select("k", "k2")
    left = classes2.join(mixed2, ["k", "k2"]).selectExpr("rep.d d", "rep.at at", "rep.lo lo", "rep.hi hi", "c = 1 and rep.one open")
    fine = left.join(ctx.drop("one"), ["d", "at"]).withColumnRenamed("open", "one").mapInArrow(tidy(_cells(length, 1)), cell)
    twice = fine.groupBy("k", "k2").count().filter("count > 1").select("k", "k2")
    whole3 = fine.filter("one").join(twice, ["k", "k2"], "left_semi").select("d", "at", "lo", "hi")

    found = whole.union(whole2).union(whole3)
    return found.selectExpr("d _d", "at & 65535 _r", f"shiftleft(shiftright(at, 33) - hi, 32) | (shiftright(at, 33) - lo + {length}) span").groupBy("_d", "_r").agg(F.collect_set("span").alias("spans"))


def _cut(docs: DataFrame, row, length: int) -> DataFrame:
    """(_row, kept, kept_text, n_bytes, n_removed, n_spans); row: what becomes of docs' columns."""
    if not 2 * K <= length <= 255:
        raise ValueError("length must be from 32 to 255")
    text = F.coalesce("text", F.lit(""))
    base = docs.select(row.alias("_row"), text.alias("text"), F.xxhash64(text).alias("_d"), F.pmod(F.xxhash64(F.lit(7), text), F.lit(65536)).alias("_r"))
    out = base.join(_spans(base.select("_d", "_r", "text"), length), ["_d", "_r"], "left").select("_row", "text", "spans")
    return out.mapInArrow(tidy(_remove), f"_row {kind_of(base, '_row')}, kept binary, kept_text string, n_bytes long, n_removed long, n_spans long")


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with the repeated bytes cut out of ``text`` (null becomes empty); bytes of a character that was cut in two go as well."""
    out = _cut(docs, row_without(docs, "text"), length)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


RESULTS = ("kept", "n_bytes", "n_removed", "n_spans")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with ``kept`` (the bytes of ``text`` that stay), n_bytes, n_removed and n_spans in place of ``text``.

    ``length``: bytes of the shortest string that counts as a repeat (from 2 * 16 to 255).
    """
    return _cut(docs, row_without(docs, "text", *RESULTS), length).select("_row.*", *RESULTS)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, 200).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 200 bytes by itself, texts as hexadecimal digits; equality is that of MD5.
ORACLE_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
starts AS (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) i FROM d WHERE length(h) >= 400),
w AS MATERIALIZED (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) k FROM starts),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
led AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END fresh FROM hit),
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) run FROM led),
runs AS MATERIALIZED (SELECT r, min(i) lo, max(i) + 200 hi FROM numbered GROUP BY r, run),
gaps AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) a, lo z, hi - lo gone FROM runs
  UNION ALL SELECT r, max(hi), NULL, NULL FROM runs GROUP BY r),
cut AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, length(h) // 2) - a)), '' ORDER BY a) kept, sum(gone) gone, count(gone) n
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) n_bytes, CAST(coalesce(gone, 0) AS BIGINT) n_removed, CAST(coalesce(n, 0) AS BIGINT) n_spans,
       sha256(unhex(coalesce(kept, h))) kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
