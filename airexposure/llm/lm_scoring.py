"""Language-model scoring by the weights of a backoff automaton over n-grams.

The automaton is not built as a table of states: the arcs that a text takes are found by the n-grams that end at each of its
tokens, all tokens at once, and a failure arc is taken where an n-gram has no count. What follows is the automaton whose path
and weights these are.

States are the histories of up to ``order`` - 1 tokens that stand in the training texts, and the empty history. A state's
arcs carry log10 p(next | history) for the tokens that follow it there; its failure arc carries log10 of the weight left for
all others and leads to the history without its first token. A text is scored in one left-to-right traversal: the state
is the longest history known; a token without an arc takes failure arcs until there is one, down to the empty history, where
every token has p = (c + 1) / (N + V + 1). With c(h, v) counts and c(h) their sum, p(v | h) = (c(h, v) + S p(v | h')) / (c(h) + S),
h' being h without its first token (a Dirichlet prior of strength S): all p of a state sum to one, and the failure weight is
S / (c(h) + S). Each text ends with one end token and starts in the state of the end token.

Counts cover all training texts and every n-gram counted is an arc, however rare: the automaton grows with the texts, and no
task ever holds it whole.

1. Texts are dealt into blocks of about ``BLOCK`` bytes by their places in the files, which stay the same when a task is
   repeated. Each block's distinct n-grams and their counts go, as sorted packed runs, to the task of their key range.
2. There counts are summed over the blocks (a frequent n-gram comes once from each block at most, so none is hot), and
   each block is sent the totals of its own n-grams in the same order, without the keys.
3. Each block has the counts of all arcs that its texts can take, and adds up the weights along their paths.

A null text is empty and consists of the end token. Held-out rows are those with crc32(doc_id as text) mod 7 = 2; a null
doc_id is a training row. Repeated rows count each. Tokens and n-grams are told apart by 63-bit hashes. Columns called like
the results go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, materialize, read, row_without
from .textbytes import SPACE_WORDS, chunks, hash_slices, lower, mix, nullable, tidy, tidy_group, tidy_groups, words

END = 1  # key of the end token
ORDER = 3
STRENGTH = 16.0
BLOCK = 6 << 20  # text bytes of a block
RANGE = 1 << 21  # n-grams whose counts are summed at once, about
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(keys of all tokens, each text followed by the end token, and where each text begins); keys of tokens are odd."""
    data = lower(data)
    starts, ends, index = words(data, offsets, SPACE_WORDS)
    n = len(offsets) - 1
    at = index + np.arange(n + 1)
    out = np.full(int(at[-1]), END, dtype=np.uint64)
    keep = np.ones(len(out), dtype=bool)
    keep[at[1:] - 1] = False
    out[keep] = hash_slices(data, starts, ends) | _ONE
    return out, at


def _grams(tokens: np.ndarray, at: np.ndarray, order: int):
    """For n = 1 .. order: (keys of the n-grams that end at each token, whether there is one); keys of several tokens are even."""
    start = np.zeros(len(tokens), dtype=bool)
    start[at[:-1]] = True
    out = [(tokens, np.ones(len(tokens), dtype=bool))]
    for n in range(2, order + 1):
        keys, known = out[-1]
        history, has = np.empty_like(keys), np.zeros(len(keys), dtype=bool)
        history[1:], has[1:] = keys[:-1], known[:-1]
        if n == 2:
            history[start], has[start] = END, True
        else:
            has &= ~start
        out.append((mix(history * _ODD + tokens) & ~_ONE, has))
    return out


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first, up to the highest byte that any of them needs."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + len(values).to_bytes(8, "little") + np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(packed) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    out = np.zeros((int.from_bytes(raw[1:9].tobytes(), "little"), 8), dtype=np.uint8)
    out[:, : raw[0]] = raw[9:].reshape(int(raw[0]), len(out)).T
    return out.view(np.uint64).ravel()


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(parts)
    parts.clear()
    every.sort()
    return every[np.r_[True, every[1:] != every[:-1]]]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Sorted distinct keys with their counts summed; empties the lists."""
    every, weights = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    order = np.argsort(every)
    every, weights = every[order], weights[order]
    del order
    new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[new], np.add.reduceat(weights, new)


def _count(order: int, ranges: int):
    """Arrow function: (block, text, learn) to packed runs (block, place, keys, counts) of each block's n-grams by key range."""

    def packed(block: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        place = np.minimum((keys.astype(np.float64) * (ranges / 2.0**64)).astype(np.int64), ranges - 1)
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.r_[cuts[1:], len(keys)]
        steps = [np.diff(keys[s:e], prepend=np.uint64(0)) for s, e in zip(cuts, ends)]
        return pa.record_batch(
            [pa.array([block] * len(cuts), pa.int64()), pa.array(place[cuts]), pa.array([_pack(x) for x in steps], pa.binary()), pa.array([_pack(counts[s:e]) for s, e in zip(cuts, ends)], pa.binary())],
            ["block", "place", "keys", "counts"],
        )

    def run(batches):
        block, keys, counts, size = None, [], [], 0
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            learns = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist() if len(blocks) else []
            for s, e in zip(cuts, [*cuts[1:], len(blocks)]):
                if keys and (blocks[s] != block or size > BLOCK):
                    yield packed(block, *_merged(keys, counts))
                    size = 0
                block = int(blocks[s])
                for first, offsets, data in chunks(batch.column(1).slice(s, e - s)):
                    tokens, at = _tokens(data, offsets)
                    learn = np.repeat(learns[s + first : s + first + len(at) - 1], np.diff(at))
                    grams = _grams(tokens, at, order)
                    # of a token that is not learned from, the n-grams are only asked for
                    k, c = _merged([x[has] for x, has in grams], [learn[has].astype(np.uint32) for _, has in grams])
                    keys.append(k)
                    counts.append(c)
                    size += len(data)
        if keys:
            yield packed(block, *_merged(keys, counts))

    return run


def _total(table: pa.Table) -> pa.Table:
    """The runs of one key range to (block, place, totals) for each block, and what the range adds to N and V."""
    blocks = table["block"].to_numpy()
    runs = [np.cumsum(_unpack(k.as_buffer()), dtype=np.uint64) for k in table["keys"]]
    keys, inverse = np.unique(np.concatenate(runs), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate([_unpack(c.as_buffer()) for c in table["counts"]]), minlength=len(keys)).astype(np.int64)
    ends = np.cumsum([len(r) for r in runs])
    of_block: dict[int, list] = {}
    for b, e, r in zip(blocks.tolist(), ends.tolist(), runs):
        of_block.setdefault(b, []).append(inverse[e - len(r) : e])
    out = [_pack(totals[x[0] if len(x) == 1 else np.unique(np.concatenate(x))]) for x in of_block.values()]
    words_ = totals[(keys & _ONE) == 1]
    first = [1] + [0] * (len(out) - 1)
    return pa.table({
        "block": pa.array(list(of_block), pa.int64()), "place": pa.array([table["place"][0].as_py()] * len(out), pa.int64()), "totals": pa.array(out, pa.binary()),
        "n": pa.array([int(words_.sum()) * f for f in first], pa.int64()), "v": pa.array([int((words_ > 0).sum()) * f for f in first], pa.int64()),
    })


def traverse(counts: list[np.ndarray], has: list[np.ndarray], at: np.ndarray, texts: int, n: int, v: int, strength: float):
    """log10 weights of each token on the empty history's arc and on the traversal's path.

    counts[k], has[k]: of the (k + 1)-gram that ends at each token, 0 where no training text has it. texts: training texts.
    """
    base = np.log10((counts[0] + 1.0) / (n + v + 1.0))
    weight = base
    for k in range(1, len(counts)):
        of_history = np.zeros(len(base))
        of_history[1:] = counts[k - 1][:-1]
        if k == 1:
            of_history[at[:-1]] = texts
        failure = np.log10(strength / (of_history + strength))
        with np.errstate(divide="ignore"):
            arc = np.log10((counts[k] + strength * 10.0**weight) / (of_history + strength))
        weight = np.where(has[k], np.where(counts[k] > 0, arc, failure + weight), weight)
    return base, weight


def _score(order: int, n: int, v: int, strength: float):
    """Arrow function on a block's texts (_row, text) and totals (place, totals)."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts, found, keys = [], [], []
        for batch in texts.select(["_row", "text"]).to_batches():
            for first, offsets, data in chunks(batch.column(1)):
                tokens, at = _tokens(data, offsets)
                grams = _grams(tokens, at, order)
                rows = batch.column(0).slice(first, len(at) - 1)
                parts.append((rows.cast(nullable(rows.type)), tokens, at))
                keys.append(_distinct([x[has] for x, has in grams]))
        keys = _distinct(keys)
        packed = answers["totals"].combine_chunks()
        totals = np.concatenate([_unpack(packed[int(i)].as_buffer()) for i in np.argsort(answers["place"].to_numpy(), kind="stable")])
        if len(totals) != len(keys):
            raise ValueError("the texts of a block changed between two readings")
        ends = totals[np.searchsorted(keys, np.uint64(END))]
        for rows, tokens, at in parts:
            counts, has = [], []
            for k, h in _grams(tokens, at, order):
                c = np.zeros(len(h))
                c[h] = totals[np.searchsorted(keys, k[h])]
                counts.append(c)
                has.append(h)
            base, weight = traverse(counts, has, at, int(ends), n, v, strength)
            known = (counts[0] > 0).astype(np.int64)
            sums = [np.add.reduceat(x, at[:-1]) for x in (known, base, weight)]
            found.append(pa.record_batch([rows, pa.array(np.diff(at)), *map(pa.array, sums)], ["_row", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(found)

    return run


def _placed(rows: DataFrame, columns: list[str], per: int, blocks_of: str = "block") -> DataFrame:
    """rows of Parquet files with the block of each, a run of ``per`` rows of a file."""
    where = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / per))
    return rows.select(where.alias(blocks_of), *columns)


def _scores(rows: DataFrame, order: int, strength: float) -> DataFrame:
    """rows (_row, text, learn): scores of those with a _row, learning from those with learn."""
    columns = ["_row", "text", "learn"]
    try:
        _placed(rows, columns, 1)
    except AnalysisException:  # rows that come from no file get places by being written
        rows = materialize(rows, "texts")
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).head()
    per = max(1, n_rows * BLOCK // max(1, size + n_rows))
    ranges = 1 + size * order // (6 * RANGE)  # a token and its space take some six bytes
    texts = _placed(rows, columns, per)
    runs = texts.select("block", "text", "learn").mapInArrow(tidy(_count(order, ranges)), "block long, place long, keys binary, counts binary")
    answers = materialize(runs.groupBy("place").applyInArrow(tidy_group(_total), "block long, place long, totals binary, n long, v long"), "totals")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).head()
    schema = f"_row {kind_of(rows, '_row')}, n_tokens long, n_known long, base_score double, score double"
    out = texts.groupBy("block").cogroup(answers.select("block", "place", "totals").groupBy("block")).applyInArrow(tidy_groups(_score(order, n, v, strength)), schema)
    return out.filter("_row IS NOT NULL").withColumn("train_tokens", F.lit(n).cast("long")).select("_row.*", *RESULTS)


def lm_scores(docs: DataFrame, train: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score, learning from train.text."""
    named = docs.select(row_without(docs, "text", *RESULTS).alias("_row"), "text", F.lit(False).alias("learn"))
    learned = train.select(F.lit(None).cast(named.schema["_row"].dataType).alias("_row"), "text", F.lit(True).alias("learn"))
    return _scores(named.unionByName(learned), order, strength)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.struct("doc_id", held.alias("held_out")).alias("_row"), "text", (~held).alias("learn"))
    return _scores(rows, ORDER, STRENGTH).select("doc_id", "held_out", *RESULTS)
