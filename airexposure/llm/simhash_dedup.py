"""SimHash near-duplicates, found by a generalised pigeonhole search over the distinct fingerprints.

1. ``fingerprints``: one 64-bit SimHash per row from word shingles.
2. ``bit_parts``: correlated bits are grouped into two or three partitions, from counts over all distinct fingerprints; how
   many follows from the number of fingerprints (``parts_for``), so that probes stay selective.
3. ``allocate``: two fingerprints at distance <= tau agree within t_i bits in some partition i whenever the t_i sum to
   tau - partitions + 1 (t_i = -1: not probed). A dynamic program picks each fingerprint's t_i by the candidates that they
   are estimated to bring: its own partition values' counts where they are frequent, the mean elsewhere.
4. Probes meet the partition values of all fingerprints in an equi-join; candidates are verified bit by bit.
5. Where every allocation is estimated to cost more than ``MIDPOINTS`` (dense clusters), the fingerprint goes to an exact
   way whose work is linear: two fingerprints within 2 bits share one of the 65 values within 1 bit of each, so those
   values become nodes of the link graph. No cap or sample is involved, and no group is expanded into its pairs.
6. Components by star contraction (see components.py).

Nulls and texts without words have fingerprint zero and are linked like any others; ties (exactly half of the shingles)
give a zero bit; repeated rows share a fingerprint; a null doc_id never is a component's id unless all are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, read
from .components import connected_components
from .textbytes import SPACE_WORDS, chunks, lower, tidy, words

PARTS = (3, 2)  # partitions that are weighed against each other
HOT = 1e-4  # share of the fingerprints from which a partition value is frequent: at most 3 / HOT values
MIDPOINTS = 65
_ROW = 1 << 15  # shingles whose bits are counted at once


def _simhash(width: int):
    """Arrow function over (columns ..., text last): the other columns and the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.zeros(batch.num_rows, dtype=np.uint64)
            for first, offsets, data in chunks(batch.column(batch.num_columns - 1)):
                data = lower(data)
                starts, ends, index = words(data, offsets, SPACE_WORDS)
                if not len(starts):
                    continue
                # all words, each followed by one space; a word that ends its text has none behind it in the data
                sizes = ends - starts
                at = np.cumsum(sizes + 1) - sizes - 1
                flat = np.full(int(at[-1] + sizes[-1] + 1), 32, dtype=np.uint8)
                inside = SPACE_WORDS[data]
                keep = np.ones(len(flat), dtype=bool)
                keep[at + sizes] = False
                flat[keep] = data[inside]
                count = np.diff(index)
                shingles = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
                total = int(shingles.sum())
                owner = np.repeat(np.arange(len(count)), shingles)
                begin = np.arange(total) - np.repeat(np.cumsum(shingles) - shingles, shingles) + index[owner]
                end = np.minimum(begin + width, index[owner + 1]) - 1
                raw, x = flat.tobytes(), xxhash.xxh64_intdigest
                h = np.fromiter((x(raw[i:j], 42) for i, j in zip(at[begin].tolist(), (at[end] + sizes[end]).tolist())), dtype=np.uint64, count=total)
                bits = np.zeros((len(count), 64), dtype=np.int64)
                for i in range(0, total, _ROW):
                    own = owner[i : i + _ROW]
                    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    ones = np.unpackbits(h[i : i + _ROW].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    bits[own[new]] += np.add.reduceat(ones, new, axis=0, dtype=np.int32)
                ones = (2 * bits > shingles[:, None]).astype(np.uint8)
                prints[first : first + len(count)] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
            yield pa.record_batch([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each text over shingles of ``width`` words, fp a signed long."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(tidy(_simhash(width)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _pair_counts(batches):
    """Counts of set bits and of pairs of set bits."""
    total, n = np.zeros((64, 64)), 0
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 1 << 14):
            part = np.ascontiguousarray(fps[i : i + (1 << 14)])
            x = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(part)
    yield pa.record_batch([pa.array(np.arange(4096)), pa.array(total.ravel()), pa.array(np.full(4096, n, dtype=np.int64))], ["cell", "ones", "n"])


def parts_for(n: int, tau: int = 2) -> int:
    """How many partitions to search n evenly spread fingerprints with: the number for which the cheapest allocation costs least.

    Fewer partitions have more bits each, so values stay selective where fingerprints are many.
    """

    def cost(m: int) -> float:
        sizes = [64 * (k + 1) // m - 64 * k // m for k in range(m)]
        each = [[np.array([0.0]), *[np.array([len(_flips(s, t)) * (0.1 + n / 2.0**s)]) for t in range(tau + 1)]] for s in sizes]
        return float(allocate(each, tau)[1][0])

    return min(PARTS, key=cost)


def bit_parts(distinct: DataFrame, parts: int | None = None) -> tuple[list[list[int]], int]:
    """Bits grouped so that those that go together share a partition, and the number of fingerprints; parts: by that number, unless given."""
    rows = distinct.select("fp").mapInArrow(_pair_counts, "cell long, ones double, n long").groupBy("cell").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect()
    n = rows[0]["n"] if rows else 0
    both = np.zeros((64, 64))
    for r in rows:
        both[divmod(r["cell"], 64)] = r["ones"] / max(n, 1)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    parts = parts or parts_for(n)
    for k in range(parts):
        size = 64 * (k + 1) // parts - 64 * k // parts
        group = [max(sorted(free), key=lambda b: corr[b, list(free)].sum())]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out, n


def _value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _flips(size: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(size), k)], dtype=np.int64)


def _part_values(parts):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.record_batch([pa.array(np.tile(fps, len(parts)).view(np.int64)), pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), len(fps))), pa.array(np.concatenate([_value(fps, b) for b in parts]))], ["fp", "part", "value"])

    return run


def allocate(costs: list[list[np.ndarray]], tau: int) -> tuple[np.ndarray, np.ndarray]:
    """costs[i][t + 1]: of threshold t = -1 .. tau in partition i, for each fingerprint. The cheapest thresholds with sum
    tau - partitions + 1, by dynamic programming over partitions and sums; (thresholds, cost)."""
    m, n = len(costs), len(costs[0][0])
    target = tau + 1  # of the t_i + 1
    best = np.full((target + 1, n), np.inf)
    best[0] = 0
    picks = []
    for i in range(m):
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
        for s in range(target + 1):
            for t in range(s + 1):
                c = best[s - t] + costs[i][t]
                better = c < new[s]
                new[s][better], pick[s][better] = c[better], t
        best = new
        picks.append(pick)
    out, s = np.zeros((m, n), dtype=np.int8), np.full(n, target)
    for i in reversed(range(m)):
        out[i] = picks[i][s, np.arange(n)]
        s = s - out[i]
    return out - 1, best[target]


def _probes(parts, tau: int, n: int, hot: dict[int, tuple[np.ndarray, np.ndarray]], limit: float):
    """Arrow function: fp to its probes (fp, part, value); part -1 with a midpoint instead where probing costs too much."""

    def run(batches):
        flips = [[_flips(len(b), t) for t in range(tau + 1)] for b in parts]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values, costs = [_value(fps, b) for b in parts], []
            for i, b in enumerate(parts):
                mean, (keys, counts) = n / 2.0 ** len(b), hot.get(i, (np.zeros(0, np.int64), np.zeros(0)))
                row = [np.zeros(len(fps))]
                for t in range(tau + 1):
                    cost = np.full(len(fps), len(flips[i][t]) * (0.1 + mean))
                    if len(keys):
                        for f in flips[i][t] if t < 2 else flips[i][1]:
                            at = np.minimum(np.searchsorted(keys, values[i] ^ f), len(keys) - 1)
                            cost += np.where(keys[at] == values[i] ^ f, counts[at], 0)
                    row.append(cost)
                costs.append(row)
            picked, cost = allocate(costs, tau)
            exact = cost > limit
            out = []
            for i in range(len(parts)):
                for t in range(tau + 1):
                    own = np.flatnonzero((picked[i] == t) & ~exact)
                    f = flips[i][t]
                    out.append((np.repeat(fps[own], len(f)), i, (values[i][own][:, None] ^ f).ravel()))
            one = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
            own = fps[exact]
            out.append((np.repeat(own, 65), -1, (own[:, None] ^ one).ravel().view(np.int64)))
            for f, i, v in out:
                if len(f):
                    yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(np.full(len(f), i, dtype=np.int32)), pa.array(v)], ["fp", "part", "value"])

    return run


def link_fingerprints(distinct: DataFrame, tau: int = 2, partitions: int | None = None) -> DataFrame:
    """(a, b) edges between the given distinct fingerprints; the components are those of all pairs within tau <= 2 bits.

    Midpoints of the exact way are nodes too; they are told from fingerprints by the edge's ``mid`` flag.
    """
    if tau != 2:
        raise ValueError("the exact way for dense clusters is for 2 bits")
    parts, n = bit_parts(distinct, partitions)
    values = distinct.select("fp").mapInArrow(_part_values(parts), "fp long, part int, value long")
    hot: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in sorted(values.groupBy("part", "value").count().filter(F.col("count") > max(8.0, HOT * n)).collect()):  # at most 3 / HOT rows
        k, c = hot.setdefault(r[0], ([], []))
        k.append(r[1])
        c.append(float(r[2]))
    hot = {i: (np.array(k, dtype=np.int64), np.array(c)) for i, (k, c) in hot.items()}
    probes = distinct.select("fp").mapInArrow(_probes(parts, tau, n, hot, MIDPOINTS), "fp long, part int, value long")
    index = values.select(F.col("fp").alias("other"), "part", "value")
    pairs = probes.filter("part >= 0").join(index, ["part", "value"]).filter(f"fp <> other and bit_count(fp ^ other) <= {tau}").selectExpr("fp a", "other b", "false mid").distinct()
    return pairs.unionByName(probes.filter("part < 0").selectExpr("fp a", "value b", "true mid"))


def near_duplicates(docs: DataFrame, width: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id linked to the row directly or through others."""
    rows = materialize(fingerprints(docs, width), "fingerprints")
    distinct = rows.select("fp").distinct()
    edges = link_fingerprints(distinct, tau)
    # a midpoint that is itself a fingerprint is the same node: it is within one bit of the other end
    nodes = connected_components(edges.select("a", "b"))
    roots = nodes.selectExpr("node fp", "root")
    with_root = rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = with_root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return with_root.join(first, "root").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = 3, tau: int = 2) -> DataFrame:
    """One row with a doc_id of each group, that of the smallest one, and one without: rows are told apart by doc_id and a 128-bit hash of
    the text, and of rows equal in both any one stays.

    Rows without doc_id take part in the method, but go only for the sake of others without.
    """
    parts = [F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g")]
    found = near_duplicates(docs.select(F.struct(*parts).alias("doc_id"), "text"), width, tau)
    # rows with a doc_id come first, so only those without may need another row than their component's first
    found = materialize(found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n")), "found")
    unnamed = found.filter("doc_id.unnamed")
    own = unnamed.groupBy("c").agg(F.min("doc_id").alias("first"))
    firsts = found.filter("not doc_id.unnamed").selectExpr("doc_id", "c first", "n").unionByName(unnamed.join(own, "c").select("doc_id", "first", "n"))
    # the rows that go are far fewer than those that stay, so up to larger inputs Spark need not shuffle the texts
    i, h, g = free_names(docs, "_id", "_h", "_g")
    marked = materialize(firsts.filter("doc_id <> first or n > 1").select(F.col("doc_id.doc_id").alias(i), F.col("doc_id.h").alias(h), F.col("doc_id.g").alias(g), F.expr("doc_id = first").alias("again")), "marked")
    h2, g2 = free_names(docs, "_own_h", "_own_g")
    rows = docs.withColumns({h2: F.xxhash64("text"), g2: F.xxhash64(F.lit(7), "text")})
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h2) == F.col(h)) & (F.col(g2) == F.col(g))
    out = rows.join(marked.drop("again"), same, "left_anti")
    again = marked.filter("again").drop("again")
    # nothing but a saving: without such rows both sides are empty
    if again.limit(1).count():
        out = out.unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", h2, g2]))
    return out.select(*docs.columns)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
