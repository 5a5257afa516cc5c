"""Conversation structure repair: the cheapest edits that make a conversation an optional system row and then user and assistant in turn.

``chunked``: all rows in one order, by ranges of (conversation, turn, ...), cut into chunks of one conversation of at most
CHUNK_ROWS rows and CHUNK_BYTES (a longer text is a chunk of its own), so a long conversation is spread like others.
``coded``: each chunk as two strings, the roles' initials and the faults of its rows.
``solved``: the least costs to go from each row on, backward over four states (start, system, user, assistant), by rank
convergence: every chunk but the last of a conversation starts from a speculative vector of costs; passes over the chunks
whose right neighbour came out otherwise run anew, beside the old vectors, until old and new differ only by a constant, and
end when no chunk changes. Vectors are kept with their least cost taken off: constants never decide between edits.
``traced``: each chunk follows its costs for all four states that could enter it; the states that do enter come from
composing these maps by doubling along the conversation. At each place the first letter of D, I, K, R that keeps to the
least cost is taken, which gives the least audit, since a letter leaves no choice of the state that follows.
``repaired``: the texts of each chunk under its edits, hashed chunk after chunk.

Null roles and texts count as one space; null turns come first; rows of one turn go by role and by the SHA-256 of the text;
repeated rows are rows of their own (and duplicates); null conv_id is a conversation of its own; a conversation without rows
has no edits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, kind_of, materialize, read
from .textbytes import tidy

CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the role that a changed or inserted row takes
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
SOLID, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
_STATES = T.ArrayType(T.IntegerType())


def damaged(talk: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, _tie) with the planted damage; _tie: the order of rows of one turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = talk.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("_k"))
    rows = rows.withColumn("_tie", F.struct("role", F.sha2("text", 256))).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "_tie", copies.alias("_copy")).drop("_copy")


def _cut(most: int):
    """Rows in order (conv_id, ..., _at, _size) with _chunk, the place of the first row of their chunk."""

    def run(batches):
        conv = chunk = None
        count = size = 0
        for batch in batches:
            convs, ats, sizes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "_at", "_size"))
            out = []
            for c, at, n in zip(convs, ats, sizes):
                if chunk is None or c != conv or count >= most or size + n > CHUNK_BYTES:
                    conv, chunk, count, size = c, at, 0, 0
                count += 1
                size += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "_chunk"])

    return run


def chunked(rows: DataFrame, most: int = CHUNK_ROWS) -> DataFrame:
    """rows of ``damaged`` with _at, their place in the order of all rows, and _chunk."""
    bounded_batches(rows.sparkSession)
    order = ["conv_id", "turn", "_tie", "_id"]
    # _id only splits many equal rows
    placed = rows.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    sized = placed.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_at"), F.octet_length("text").alias("_size"))
    schema = ", ".join(f"{c} {kind_of(sized, c)}" for c in sized.columns)
    return sized.mapInArrow(tidy(_cut(most)), f"{schema}, _chunk long").drop("_size")


def coded(rows: DataFrame) -> DataFrame:
    """Chunks (conv_id, _chunk, initials, faults, i, of): a letter a row; the chunk's number in its conversation from 0, and how many there are."""
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("_sha")).agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("_new"))
    initial = F.substring("role", 1, 1)
    letters = rows.select("_at", "conv_id", "_chunk", F.col("text").rlike(SOLID).alias("_s"), F.col("text").rlike(ENDED).alias("_e"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("_i"))
    fault = F.when(~F.col("_s"), "b").when(F.col("_new").isNull(), "d").when(~F.col("_e"), "t").otherwise("-")
    each = letters.join(first, "_at", "left").select("conv_id", "_chunk", F.struct("_at", "_i", fault.alias("_f")).alias("_r"))
    chunks = each.groupBy("conv_id", "_chunk").agg(F.array_sort(F.collect_list("_r")).alias("_r"))  # at most CHUNK_ROWS
    chunks = chunks.select("conv_id", "_chunk", F.array_join("_r._i", "").alias("initials"), F.array_join("_r._f", "").alias("faults"))
    whole = Window.partitionBy("conv_id")  # of chunks
    numbered = chunks.select("conv_id", "_chunk", (F.row_number().over(whole.orderBy("_chunk")) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("of"))
    return chunks.join(numbered.select("_chunk", "i", "of"), "_chunk")


def _closed(w: list[int]) -> tuple[int, ...]:
    """Costs to go before any insertion, from costs to go after it."""
    user, assistant = min(w[USER], INSERT + w[ASSISTANT]), min(w[ASSISTANT], INSERT + w[USER])
    return min(w[START], INSERT + user), min(w[SYSTEM], INSERT + user), user, assistant


def _normal(v) -> tuple[int, ...]:
    least = min(v)
    return tuple(x - least for x in v)


END = _closed([0, 1 << 20, 1 << 20, 0])
SPECULATIVE = (0, 0, 0, 0)


def _options(state: int, initial: str, fault: str):
    """(letter, cost, next state) of the edits of one row, insertions apart, by letter."""
    yield "D", DELETE, state
    if fault in "t-":
        more = TRUNCATED if fault == "t" else 0
        if (state, initial) in KEPT:
            yield "K", more, KEPT[state, initial]
        yield "R", REROLE + more, NEXT[state]


@functools.lru_cache(1 << 16)
def _back(right: tuple[int, ...], initial: str, fault: str) -> tuple[int, ...]:
    """Costs to go before a row from those after it; few vectors occur, so most steps are known."""
    return _normal(_closed([min(cost + right[to] for _, cost, to in _options(s, initial, fault)) for s in range(4)]))


def backward(initials: str, faults: str, right: tuple[int, ...], old: tuple[int, ...] | None = None) -> tuple[int, ...] | None:
    """Costs to go before the first row; beside ``old``, None as soon as both differ only by a constant."""
    right = _normal(right)
    for i in range(len(initials) - 1, -1, -1):
        if old is not None:
            if old == right:
                return None
            old = _back(old, initials[i], faults[i])
        right = _back(right, initials[i], faults[i])
    return None if old == right else right


def forward(initials: str, faults: str, right: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    """(letters, cost, state behind) of the least edits from a state on."""
    right = _normal(right)
    costs = [right]
    for i in range(len(initials) - 1, -1, -1):
        costs.append(_back(costs[-1], initials[i], faults[i]))
    costs.reverse()
    out, total, i = [], 0, 0
    n = len(initials)
    while i < n:
        # costs[i] is that of the row's best edits but for a constant, which the best of all four states gives
        after = costs[i + 1]
        ways = [[(letter, cost + after[to], cost, to, 1) for letter, cost, to in _options(s, initials[i], faults[i])] for s in range(4)]
        v = _closed([min(w[1] for w in ways[s]) for s in range(4)])
        every = sorted([*ways[state], ("I", INSERT + v[NEXT[state]], INSERT, NEXT[state], 0)])
        letter, _, cost, state, step = next(w for w in every if w[1] == v[state])
        out.append(letter)
        total += cost
        i += step
    while last and state not in (START, ASSISTANT):
        out.append("I")
        total += INSERT
        state = NEXT[state]
    return "".join(out), total, state


@F.pandas_udf(_STATES)
def _left(initials: pd.Series, faults: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([backward(i, f, tuple(r)) for i, f, r in zip(initials, faults, right)], dtype=object)


@F.pandas_udf(_STATES)
def _left_again(initials: pd.Series, faults: pd.Series, right: pd.Series, old: pd.Series) -> pd.Series:
    return pd.Series([backward(i, f, tuple(map(int, r)), tuple(map(int, o))) for i, f, r, o in zip(initials, faults, right, old)], dtype=object)


@F.pandas_udf(_STATES)
def _exits(initials: pd.Series, faults: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[forward(i, f, tuple(map(int, r)), s, False)[2] for s in range(4)] for i, f, r in zip(initials, faults, right)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("letters", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType())]))
def _trace(initials: pd.Series, faults: pd.Series, right: pd.Series, state: pd.Series, last: pd.Series) -> pd.DataFrame:
    out = [forward(i, f, tuple(map(int, r)), s, z)[:2] + (sum(a + b not in LEGAL for a, b in zip(i, i[1:])),) for i, f, r, s, z in zip(initials, faults, right, state, last)]
    return pd.DataFrame(out, columns=["letters", "cost", "illegal"])


def _vector(v) -> F.Column:
    return F.array(*[F.lit(x).cast("int") for x in v])


def solved(chunks: DataFrame) -> DataFrame:
    """chunks with ``right``, the costs to go behind their last row (but for a constant)."""
    last = F.col("i") == F.col("of") - 1
    begun = chunks.withColumn("right", F.when(last, _vector(END)).otherwise(_vector(SPECULATIVE)))
    one = begun.filter("of = 1")
    now = materialize(begun.filter("of > 1").withColumn("left", _left("initials", "faults", "right")), "costs")
    w = Window.partitionBy("conv_id").orderBy("i")  # of chunks
    while True:
        met = now.withColumn("_right", F.coalesce(F.lead("left").over(w), "right"))
        stale = met.filter(F.col("_right") != F.col("right"))
        if not stale.head(1):
            return one.unionByName(now.drop("left"))
        again = _left_again("initials", "faults", "_right", "right")
        anew = stale.withColumn("left", F.coalesce(again, "left"))
        now = materialize(met.filter(F.col("_right") == F.col("right")).unionByName(anew).withColumn("right", F.col("_right")).drop("_right"), "costs")


def traced(chunks: DataFrame) -> DataFrame:
    """chunks of ``solved`` with state (the one that enters), letters, cost and illegal (pairs of roles inside the chunk)."""
    many = chunks.filter("of > 1")
    maps = materialize(many.select("conv_id", "_chunk", "i", "of", _exits("initials", "faults", "right").alias("to")), "maps")
    w = Window.partitionBy("conv_id").orderBy("i")  # of chunks
    longest = maps.agg(F.max("of")).head()[0] or 0
    step = 1
    while step < longest:
        # what 2 * step chunks up to this one make of a state
        joined = maps.withColumn("_before", F.lag("to", step).over(w))
        maps = materialize(joined.withColumn("to", F.coalesce(F.transform("_before", lambda s: F.get("to", s)), "to")).drop("_before"), "maps")
        step *= 2
    entered = maps.select("_chunk", F.coalesce(F.get(F.lag("to").over(w), F.lit(START)), F.lit(START)).alias("state"))
    known = many.join(entered, "_chunk").unionByName(chunks.filter("of = 1").withColumn("state", F.lit(START)))
    done = known.withColumn("_t", _trace("initials", "faults", "right", "state", F.col("i") == F.col("of") - 1))
    return done.select("conv_id", "_chunk", "i", "of", "initials", "faults", "state", "_t.letters", "_t.cost", "_t.illegal")


def lines(rows: list[dict], letters: str, state: int) -> list[str]:
    """Repaired rows as role:text."""
    out, at = [], 0
    for letter in letters:
        row = None if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state, row["role"][:1]]
            out.append(f"{row['role']}:{row['text']}")
        else:
            state = NEXT[state]
            out.append(f"{ROLES[state]}:{row['text'] if row else ''}")
    return out


def _render(batches):
    """(_row, rows, letters, state, of) to (_row, text, sha): the repaired text of a chunk, or its hash where it is the whole conversation."""
    for batch in batches:
        texts, shas = [], []
        for k in range(batch.num_rows):
            rows, letters, state, of = (batch.column(c)[k].as_py() for c in range(1, 5))
            found = lines(rows, letters, state)
            text = "\n".join(found) if found else None
            shas.append(hashlib.sha256((text or "").encode()).hexdigest() if of == 1 else None)
            texts.append(text if of > 1 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(shas, pa.string())], ["_row", "text", "sha"])


def _hashed(batches):
    """Chunks (conv_id, i, of, letters, text) in order to (conv_id, audit, sha), one conversation after another; only its letters are held."""
    kind, state, letters, first = None, None, [], True
    for batch in batches:
        kind = batch.column(0).type
        for conv, i, of, part, text in zip(*[c.to_pylist() for c in batch.columns]):
            if i == 0:
                state, letters, first = hashlib.sha256(), [], True
            letters.append(part)
            if text is not None:
                state.update(("" if first else "\n").encode() + text.encode())
                first = False
            if i == of - 1:
                yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(letters)], pa.string()), pa.array([state.hexdigest()], pa.string())], ["conv_id", "audit", "sha"])


def repaired(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows of ``chunked`` under the edits of ``traced``: (conv_id, i, of, letters, text, sha), one row a chunk; sha only where it is the whole conversation."""
    texts = rows.groupBy("_chunk").agg(F.array_sort(F.collect_list(F.struct("_at", "role", "text"))).alias("_rows"))  # at most CHUNK_BYTES or one row
    both = chunks.select("_chunk", F.struct("conv_id", "i", "of", "letters").alias("_row"), "letters", "state", "of").join(texts, "_chunk")
    both = both.select("_row", F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"), "letters", "state", "of")
    return both.mapInArrow(tidy(_render), f"_row {kind_of(both, '_row')}, text string, sha string").select("_row.*", "text", "sha")


def repair(talk: DataFrame, plant: bool = False, most: int = CHUNK_ROWS) -> DataFrame:
    """One row for each conv_id of talk (conv_id, turn, role, text): faults, costs, audit and the hash of the repaired conversation.

    plant: with the damage of ``damaged``; else rows are taken as they are. most: rows of a chunk.
    """
    kind = kind_of(talk, "conv_id")
    if plant:
        rows = damaged(talk)
    else:
        rows = talk.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        rows = rows.withColumn("_tie", F.struct("role", F.sha2("text", 256)))
    rows = materialize(chunked(rows, most), "rows")
    chunks = materialize(traced(solved(materialize(coded(rows), "chunks"))), "traces")
    texts = materialize(repaired(rows, chunks), "repaired")
    order = Window.partitionBy("conv_id").orderBy("i")  # of chunks
    seam = F.when(F.col("i") > 0, (~F.concat(F.lag(F.right("initials", F.lit(1))).over(order), F.left("initials", F.lit(1))).isin(*LEGAL)).cast("long")).otherwise(0)
    count = lambda c: (F.length("faults") - F.length(F.replace("faults", F.lit(c), F.lit("")))).cast("long")
    figures = chunks.select("conv_id", count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), (F.col("illegal") + seam).alias("illegal"), "cost")
    turns = rows.filter("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    whole = texts.filter("of = 1").select("conv_id", F.col("letters").alias("audit"), "sha")
    parts = texts.filter("of > 1").select("conv_id", "i", "of", "letters", "text")
    long_ = parts.repartition("conv_id").sortWithinPartitions("conv_id", "i").mapInArrow(tidy(_hashed), f"conv_id {kind}, audit string, sha string")
    every = talk.select("conv_id").distinct()
    for more in (figures, turns, whole, long_):
        every = every.unionByName(more, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = [total(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return every.groupBy("conv_id").agg(*sums, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(nothing)).alias("repaired_sha256"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"), plant=True)
