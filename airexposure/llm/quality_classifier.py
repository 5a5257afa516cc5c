"""Quality classifier: random-indexing vectors pooled per text, then a two-layer network with calibrated probabilities.

Words have index vectors of their own, but share their learned context vectors: there are ``CELLS`` of these, two to a word, and
with a growing vocabulary a cell tends to the mean of the corpus.

1. Each word has a fixed random index vector: the sum of seeded sparse vectors of its features (the word, its ends, and the
   kinds of characters it holds), so unseen words share what they have in common with seen ones.
2. Every word, however rare, has a context vector learned from all texts: the sum of those of its two cells. A cell is one of
   ``CELLS`` that words fall into by hash, and sums the index vectors of the neighbours of all its words over all texts. The
   table has a fixed size whatever the vocabulary's; Spark adds up the tasks' partial sums before and after the shuffle.
3. A text is pooled into the mean of its words' index vectors, of their absolute deviations and of their context vectors,
   with a few rates that means cannot show (repeated words and pairs of words).
4. The network is fitted with numpy on at most ``SAMPLE`` labelled training rows (those with the smallest hashes of
   doc_id); a part of them that the weights are not fitted on sets the temperature of the probabilities.

Rows with crc32(doc_id as text) mod 3 = 1 are held out of all fitting. Scores depend on the text alone. A null text is
empty and is scored from zero vectors; without labels of both kinds every score is 0.5; repeated rows get equal scores; of
labels of one doc_id the largest counts, null ones do not. Columns called like the results go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, read, row_without
from .textbytes import SPACE_WORDS, chunks, hash_slices, lower, mix, tidy, words

DIM = 48
CELLS = 1 << 13
SAMPLE = 20_000  # labelled rows that the network is fitted on, at most
HIDDEN = 32
RESULTS = ("held_out", "score", "predicted")
RATES = 5
_KINDS = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 4 digit, 8 sentence mark, 16 other sign, 32 beyond ASCII
_KINDS[0x21:0x7F] = 16
_KINDS[0x30:0x3A] = 4
_KINDS[0x41:0x5B] = 2
_KINDS[0x61:0x7B] = 1
_KINDS[[0x21, 0x27, 0x28, 0x29, 0x2C, 0x2E, 0x3A, 0x3B, 0x3F, 0x22, 0x2D]] = 8
_KINDS[0x80:] = 32


def _places(features: np.ndarray, dim: int):
    """Two (place, sign) of the sparse index vector of each feature hash."""
    for k in (0, 1):
        h = mix(features + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        yield (h % np.uint64(dim)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)


def _features(data: np.ndarray, s: np.ndarray, e: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word's features: the word, its kinds of characters, its last two bytes, kinds with first byte."""
    cuts = np.c_[s, e].ravel()
    kind = np.bitwise_or.reduceat(_KINDS[data], cuts[:-1] if e[-1] == len(data) else cuts)[::2].astype(np.uint64)
    last, before, head = data[e - 1].astype(np.uint64), data[np.maximum(e - 2, s)].astype(np.uint64), data[s].astype(np.uint64)
    return [hashes, mix(kind + np.uint64(1 << 20)), mix((last << np.uint64(8)) + before + np.uint64(2 << 20)), mix(kind * np.uint64(256) + head + np.uint64(3 << 20))]


def _cells(hashes: np.ndarray) -> list[np.ndarray]:
    """The two cells of each word."""
    h = mix(hashes + np.uint64(5 << 20))
    return [(h % np.uint64(CELLS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(CELLS)).astype(np.int64)]


def _contexts(dim: int, window: int):
    """Arrow function: for each cell, the sum of its words' neighbours' index vectors (partial sums)."""

    def run(batches):
        total = np.zeros(CELLS * dim)
        for batch in batches:
            for _, offsets, data in chunks(batch.column(0), 4 << 20):
                data = lower(data)
                starts, ends, first = words(data, offsets, SPACE_WORDS)
                if not len(starts):
                    continue
                h = hash_slices(data, starts, ends)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                places = list(_places(h, dim))
                for cell in _cells(h):
                    for step in range(1, window + 1):
                        same = np.flatnonzero(owner[step:] == owner[:-step])
                        for word, near in ((same + step, same), (same, same + step)):
                            for at, sign in places:
                                total += np.bincount(cell[word] * dim + at[near], weights=sign[near], minlength=len(total))
        used = np.flatnonzero(total.reshape(-1, dim).any(axis=1))
        yield pa.record_batch([pa.array(used), pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1, dim)[used].ravel()), dim).cast(pa.list_(pa.float64()))], ["cell", "v"])

    return run


def cell_vectors(texts: DataFrame, dim: int = DIM, window: int = 2) -> np.ndarray:
    """Unit context vectors of all cells: CELLS rows at most reach the driver."""
    parts = texts.select("text").mapInArrow(tidy(_contexts(dim, window)), "cell long, v array<double>")
    sums = parts.groupBy("cell").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(dim)])
    out = np.zeros((CELLS, dim))
    rows = sums.toArrow()
    if rows.num_rows:
        out[rows["cell"].to_numpy()] = np.column_stack([rows[f"v{i}"].to_numpy() for i in range(dim)])
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has (hashes cut to 40 bits and more within a text)."""
    shift = np.uint64(max(1, n).bit_length())
    keys = np.sort((owner.astype(np.uint64) << (np.uint64(64) - shift)) | (hashes >> shift))
    return np.bincount((keys[np.r_[True, keys[1:] != keys[:-1]]] >> (np.uint64(64) - shift)).astype(np.int64), minlength=n) if len(keys) else np.zeros(n, np.int64)


def _pool(data: np.ndarray, offsets: np.ndarray, context: np.ndarray, dim: int) -> np.ndarray:
    """One row for each text: mean index vector, mean absolute index vector, mean context vector, rates."""
    n = len(offsets) - 1
    out = np.zeros((n, 3 * dim + RATES), dtype=np.float32)
    starts, ends, first = words(data, offsets, SPACE_WORDS)
    if not len(starts):
        return out
    size = np.diff(first)
    per = np.maximum(size, 1).astype(np.float32)
    owner = np.repeat(np.arange(n), size)
    # the case of letters tells kinds of text apart, so index vectors take words as they are; context is looked up in lower case
    for f in _features(data, starts, ends, hash_slices(data, starts, ends)):
        for at, sign in _places(f, dim):
            cell = owner * dim + at
            out[:, :dim] += np.bincount(cell, weights=sign, minlength=n * dim).reshape(n, dim)
            out[:, dim : 2 * dim] += np.bincount(cell, minlength=n * dim).reshape(n, dim)
    plain = hash_slices(lower(data), starts, ends)
    pairs, counts = np.unique(np.concatenate([owner * CELLS + cell for cell in _cells(plain)]), return_counts=True)
    text, cell = pairs // CELLS, pairs % CELLS
    new = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    for i in range(0, len(new), 256):
        lo, hi = int(new[i]), int(new[i + 256]) if i + 256 < len(new) else len(pairs)
        out[text[new[i : i + 256]], 2 * dim : 3 * dim] = np.add.reduceat(context[cell[lo:hi]] * counts[lo:hi, None].astype(np.float32), new[i : i + 256] - lo, axis=0)
    out /= per[:, None]
    same = owner[1:] == owner[:-1]
    equal = same & (plain[1:] == plain[:-1])
    pairs = mix(plain[:-1] * np.uint64(3) + plain[1:])[same]
    repeats = np.where(size > 0, 1 - (_distinct(owner[1:][same], pairs, n) + 1) / per, 0)
    out[:, 3 * dim] = np.where(size > 0, 1 - _distinct(owner, plain, n) / per, 0)
    out[:, 3 * dim + 1] = np.bincount(owner[1:][equal], minlength=n) / per
    out[:, 3 * dim + 2] = repeats
    out[:, 3 * dim + 3] = np.log1p(size) / 10
    out[:, 3 * dim + 4] = repeats / np.log1p(per)
    return out


class Network:
    """tanh layer and logistic output on standardised inputs, fitted by Adam; temperature from rows kept aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2
        if len(np.unique(y[~aside])) < 2:
            self.temperature = None
            return
        self.mean, self.scale = x[~aside].mean(0), x[~aside].std(0) + 1e-3
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        self.weights = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.fit(z[~aside], y[~aside], epochs, rng)
        self.temperature = 1.0
        if aside.any():
            logits, target = self.logits(z[aside]), y[aside]
            losses = {t: np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in np.geomspace(0.25, 8, 61)}
            self.temperature = float(min(losses, key=losses.get))

    def fit(self, z, y, epochs, rng):
        positive = y.mean()
        weight = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive)) * 0.5 + 0.5
        m, s, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), 128):
                part = order[i : i + 128]
                h = np.tanh(z[part] @ self.weights[0] + self.weights[1])
                error = weight[part] * (1 / (1 + np.exp(-(h @ self.weights[2] + self.weights[3]))) - y[part]) / len(part)
                back = np.outer(error, self.weights[2]) * (1 - h * h)
                grads = [z[part].T @ back + 1e-4 * self.weights[0], back.sum(0), h.T @ error + 1e-4 * self.weights[2], np.array([error.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def logits(self, z):
        return np.tanh(z @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3][0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.temperature is None:
            return np.full(len(x), 0.5)
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-self.logits(z) / self.temperature))


def _each(model, finish, name: str):
    """Arrow function: (row, text) to row and finish(pooled vectors)."""

    def run(batches):
        context, network = model.value
        for batch in batches:
            for first, offsets, data in chunks(batch.column(1)):
                x = _pool(data, offsets, context, context.shape[1])
                yield pa.record_batch([batch.column(0).slice(first, len(offsets) - 1), finish(x, network)], ["row", name])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, ...) without text, with held_out, score (probability of label 1) and predicted."""
    spark = docs.sparkSession
    context = cell_vectors(docs)
    crc = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))
    chosen = labels.filter("doc_id is not null and quality is not null").filter(~crc("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows of two numbers
    model = spark.sparkContext.broadcast((context, None))
    # ``sample`` rows of two numbers; as rows may share a doc_id, their vectors are drawn from again
    texts = docs.join(F.broadcast(chosen), "doc_id").select(F.struct("doc_id", "quality", F.xxhash64(F.lit(12), "doc_id", "text").alias("h")).alias("row"), "text")
    pooled = texts.mapInArrow(tidy(_each(model, lambda x, _: pa.array(list(x), pa.list_(pa.float32())), "x")), f"row struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, quality: {chosen.schema['quality'].dataType.simpleString()}, h: long>, x array<float>")
    pooled = pooled.orderBy("row.h").limit(sample).toPandas()
    x = np.array(pooled["x"].tolist(), dtype=np.float64).reshape(len(pooled), 3 * context.shape[1] + RATES)
    y = np.array([r["quality"] for r in pooled["row"]], dtype=np.float64)
    network = Network(x, y)
    model = spark.sparkContext.broadcast((context, network))
    named = docs.select(row_without(docs, "text", *RESULTS).alias("row"), crc("doc_id").alias("held_out"), "text")
    named = named.select(F.struct("row", "held_out").alias("row"), "text")
    out = named.mapInArrow(tidy(_each(model, lambda x, n: pa.array(n.probabilities(x)), "score")), f"row {kind_of(named, 'row')}, score double")
    return out.select("row.row.*", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
