"""SentencePiece encoding and decoding of whole texts with a given BPE model, exactly as the library does.

Encoding goes by backtracking, not by merging the text. From the left, the longest piece that starts at the place (found by
an Aho-Corasick automaton over the reversed pieces) is tried first, then its shorter prefixes. A piece may follow the one
before it only if the two are compatible: merging their joint characters anew, best score and leftmost first, must give just
these two again. Places at which no piece fits are set in a bitfield and not tried again. A row of pieces in which all
neighbours are compatible is what merging the whole text gives: merges inside a pair run in the same order whatever stands
beside it, so the first merge across a seam would also happen in the pair alone; each prefix has one such row, so a failed
place has failed for good.

Texts are cut where no piece of the vocabulary reaches across (before a run of spaces, between words and signs), and a distinct
part that a worker remembers is not encoded again. Characters without a piece become the pieces of their bytes.

``encode``: text to ids; null and empty texts have the end id alone; texts of any length are taken whole; repeated rows stay
rows of their own; an empty table gives none; ties of scores go to the leftmost merge. ``decode``: ids to text; null ids
give a null text. Other columns are handed through; those called like a result give way to it.
"""

from __future__ import annotations

import functools
import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, read, row_without
from .textbytes import tidy

SPACE = "▁"  # stands for a space within pieces
SIGNS = "".join(c for c in map(chr, [*range(0x100), *range(0x2000, 0x2070)]) if not c.isalpha() and not c.isdecimal())  # ASCII, Latin and general punctuation
PARTS, PAIRS = 250_000, 150_000  # distinct parts of texts, and pairs of pieces, that a worker remembers of late, and as many of before
LONGEST = 64  # characters of a part that is remembered
BATCH_IDS = 1 << 20


class _Remembered(dict):
    """Values that ``make`` gives, kept for keys that are not too long: those asked for lately and, of those before, the ones that are asked for again."""

    def __init__(self, make, most, size=None):
        self.make, self.most, self.size, self.old = make, most, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.size is None or self.size(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Pieces, scores and ids of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = type(model.pieces[0]).Type if model.pieces else None
        norm, spec = model.normalizer_spec, model.trainer_spec
        if spec.model_type != spec.BPE or not spec.byte_fallback or spec.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError(f"{path}: only BPE models with byte fallback and spaces before words are read")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{path}: only models without normalisation, with a space before the text, are read")
        if any(p.type in (kinds.Value("USER_DEFINED"), kinds.Value("UNUSED")) for p in model.pieces):
            raise ValueError(f"{path}: pieces defined by the user or unused are not read")
        self.end_id, self.unknown, self.unknown_text = spec.eos_id, spec.unk_id, spec.unk_surface
        scores, ids, self.byte_id = {}, {}, [0] * 256
        self.control, byte_of = set(), {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.Value("NORMAL"):
                scores[p.piece], ids[p.piece] = p.score, i
            elif p.type == kinds.Value("BYTE"):
                byte_of[i] = int(p.piece[3:5], 16)
                self.byte_id[byte_of[i]] = i
            elif p.type == kinds.Value("CONTROL"):
                self.control.add(i)
        self.byte_of = byte_of
        # decoding: what each id adds, and which ids need a look at their neighbours
        self.piece = [p.piece if p.type == kinds.Value("NORMAL") else chr(byte_of[i]) if byte_of.get(i, 128) < 128 else "" for i, p in enumerate(model.pieces)]
        self.odd = np.array([p.type != kinds.Value("NORMAL") and byte_of.get(i, 128) >= 128 for i, p in enumerate(model.pieces)])
        self.use(scores, ids)

    def use(self, scores: dict[str, float], ids: dict[str, int]) -> None:
        """Takes the pieces of a vocabulary with their scores and ids. Pieces have numbers; a character without a piece has the one that follows from its code."""
        import ahocorasick

        self.score = scores
        self.pieces = list(scores)
        self.beyond, self.base = len(self.pieces), len(self.pieces) + 0x110000
        self.ids = [ids[p] for p in self.pieces]
        self.length = [len(p) for p in self.pieces]
        number = {p: i for i, p in enumerate(self.pieces)}
        #: The longest proper prefix of each piece that is a piece, else its first character; -1 for single characters.
        self.shorter = [-1 if len(p) == 1 else next((number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in number), self.beyond + ord(p[0])) for p in self.pieces]
        self.matcher = ahocorasick.Automaton()
        for p, i in number.items():
            self.matcher.add_word(p[::-1], i)
        self.matcher.make_automaton()
        # kinds of characters: spaces, signs, others; what no piece joins can be told apart beforehand
        kind = lambda c: 0 if c == SPACE else 1 if c in SIGNS else 2
        joined = {(kind(x), kind(y)) for p in self.pieces for x, y in zip(p, p[1:]) if kind(x) != kind(y)}
        signs = re.escape(SIGNS)
        if joined <= {(0, 1), (0, 2)}:
            parts = f"{SPACE}*(?:[{signs}]+|[^{signs}{SPACE}]+)|{SPACE}+"
        elif not joined & {(1, 0), (2, 0)}:
            parts = f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        else:
            parts = "(?s).+"
        self.parts = re.compile(parts)
        self.part_ids = _Remembered(lambda part: array("i", self.ids_of(self.backtrack(part))).tobytes(), PARTS, len)
        self.steps = _Remembered(self._steps, PAIRS)
        self.compatible = _Remembered(lambda pair: self._compatible(*divmod(pair, self.base)), PAIRS)

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """The pieces of a short text by merging: the best score first, the leftmost of equals; each merge's score and the ends after it go to steps."""
        parts, score = list(text), self.score
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))

    def name(self, number: int) -> str:
        return self.pieces[number] if number < self.beyond else chr(number - self.beyond)

    def _steps(self, number: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece comes about: the scores of its merges, and its first and last part before and after each; None if merging gives other pieces."""
        piece, steps = self.name(number), []
        if len(self.merged(piece, steps)) > 1:
            return None
        return [s for s, _, _ in steps] + [-math.inf], [piece[0], *[a for _, a, _ in steps]], [piece[-1], *[b for _, _, b in steps]]

    def _compatible(self, before: int, after: int) -> bool:
        """Whether merging both pieces anew side by side never merges across their seam."""
        a, b = self.steps[before], self.steps[after]
        if a is None or b is None:
            return False
        (score_a, _, last), (score_b, first, _) = a, b
        i = j = 0
        while True:
            across = self.score.get(last[i] + first[j])
            # of equal scores the leftmost merge comes first
            if across is not None and across > score_a[i] and across >= score_b[j]:
                return False
            if score_a[i] >= score_b[j]:
                if score_a[i] == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _longest(self, text: str):
        """A function of (end of the reversed text, default) that gives the longest piece there."""
        found = self.matcher.iter(text[::-1])
        if len(text) <= LONGEST:
            # the automaton names the longest match at each place first, so the last entry that dict() sees is the one to keep
            return dict(reversed(list(found))).get
        best = array("i", [-1]) * len(text)
        for end, number in found:
            if best[end] < 0:
                best[end] = number
        return lambda end, default: best[end] if best[end] >= 0 else default

    def backtrack(self, text: str) -> list[int]:
        """The numbers of the pieces of a text."""
        n, beyond, base = len(text), self.beyond, self.base
        compatible, shorter, length, longest = self.compatible, self.shorter, self.length, self._longest(text)
        failed, any_failed = bytearray(n // 8 + 1), False
        out, at, before = [], 0, -1
        piece = longest(n - 1, beyond + ord(text[0]))
        while at < n:
            while piece >= 0:
                end = at + (length[piece] if piece < beyond else 1)
                fits = compatible[before * base + piece] if before >= 0 else self.steps[piece] is not None
                if fits and not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    out.append(piece)
                    at, before = end, piece
                    if at < n:
                        piece = longest(n - 1 - at, beyond + ord(text[at]))
                    break
                piece = shorter[piece] if piece < beyond else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                last = out.pop()
                at -= length[last] if last < beyond else 1
                piece = shorter[last] if last < beyond else -1
                before = out[-1] if out else -1
        return out

    def ids_of(self, numbers: list[int]) -> list[int]:
        """The ids of pieces; a character without a piece has those of its bytes."""
        out = []
        for i in numbers:
            if i < self.beyond:
                out.append(self.ids[i])
            else:
                out += [self.byte_id[b] for b in self.name(i).encode()]
        return out

    def encode(self, text: str, end: bool = True) -> bytes:
        """The ids of a text, as 32-bit integers."""
        parts = self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []
        ids = b"".join(map(self.part_ids.__getitem__, parts))
        return ids + array("i", [self.end_id]).tobytes() if end else ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: signs of control vanish, runs of bytes that are no UTF-8 become replacement characters."""
        while len(ids) and int(ids[-1]) in self.control:
            ids = ids[:-1]
        if not len(ids):
            return ""
        piece = self.piece
        if not self.odd[ids].any():
            text = "".join([piece[i] for i in ids.tolist()])
            return (text[1:] if piece[ids[0]][:1] == SPACE else text).replace(SPACE, " ")
        out, run, opened = [], bytearray(), False  # opened: the text has begun, or its first space is taken
        for i in [*ids.tolist(), -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_characters(bytes(run)))
                run, opened = bytearray(), True
            if i < 0 or i in self.control:
                continue
            if i == self.unknown:
                out.append(self.unknown_text)
            else:
                p = piece[i]
                out.append((p[1:] if not opened and p[:1] == SPACE else p).replace(SPACE, " "))
            opened = True
        return "".join(out)


def _characters(run: bytes) -> str:
    """UTF-8 characters; each byte that begins none becomes a replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        at += n
    return "".join(out)


@functools.lru_cache(1)
def codec(path: str) -> Codec:
    """The model, made once by each Python worker."""
    return Codec(path)


def _encoder(path: str, end: bool):
    def run(batches):
        c = codec(path)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                ids, offsets, first = bytearray(), [0], at
                while at < batch.num_rows and (at == first or len(ids) < 4 * BATCH_IDS):
                    ids += c.encode(texts[at].as_py() or "", end)
                    offsets.append(len(ids) // 4)
                    at += 1
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32)))
                yield pa.record_batch([batch.column(0).slice(first, at - first), lists], ["_row", "ids"])

    return run


def _decoder(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = batch.column(1)
            flat, offsets, null = np.asarray(ids.flatten()), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_pylist()
            ends = np.cumsum(offsets).tolist()
            texts = [None if gone else c.decode(flat[e - n : e]) for e, n, gone in zip(ends, offsets.tolist(), null)]
            yield pa.record_batch([batch.column(0), ids, pa.array(texts, pa.string())], ["_row", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str, end: bool = True) -> DataFrame:
    """docs with ids in place of text; end: with the model's end id after each text's own."""
    rows = docs.select(row_without(docs, "text", "ids").alias("_row"), "text")
    return rows.mapInArrow(tidy(_encoder(path, end)), f"_row {kind_of(rows, '_row')}, ids array<int>").select("_row.*", "ids")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with text from their ids."""
    parts = rows.select(row_without(rows, "text", "ids").alias("_row"), "ids")
    return parts.mapInArrow(tidy(_decoder(path)), f"_row {kind_of(parts, '_row')}, ids array<int>, text string").select("_row.*", "ids", "text")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decode(encode(docs, model_path()), model_path())
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
