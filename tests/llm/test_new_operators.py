"""SentencePiece ids against the library, spelling variants and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from airexposure.llm import conversation_repair as talk
from airexposure.llm import sentencepiece_codec as pieces
from airexposure.llm import spelling_variants as spelling

from .test_llm import docs


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ids_are_the_librarys(library):
    codec, rng = pieces.Codec(pieces.model_path()), random.Random(1)
    signs = list("abcdefghi  \n\t.e  tnhsr▁<>0s/é日本語😀\x00ñÉß́ानि")
    for k in range(3000):
        if k % 2:
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        else:
            text = "".join(rng.choice(["a", " ", "aa", "  ", " the", "ing", "er", "in", "th", library.id_to_piece(rng.randint(259, 31999))]) for _ in range(rng.randint(0, 12)))
        ids = np.frombuffer(codec.encode(text), dtype=np.int32)
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert codec.decode(ids) == library.decode(ids.tolist())
        some = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(some, dtype=np.int32)) == library.decode(some)


def test_failed_places_are_left_again():
    """A vocabulary in which the longest match is wrong time and again."""
    codec = pieces.Codec(pieces.model_path())
    rng = random.Random(4)
    for _ in range(200):
        kept = {c: -100.0 - i for i, c in enumerate("abc")}
        for i in range(rng.randint(3, 14)):
            kept.setdefault("".join(rng.choice(sorted(kept)) for _ in range(2)), -float(rng.randint(1, 9)))
        codec.use(kept, {p: i for i, p in enumerate(kept)})
        for _ in range(20):
            text = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 30)))
            assert [codec.name(i) for i in codec.backtrack(text)] == codec.merged(text)
        assert all(codec.compatible[i * codec.base + j] == (codec.merged(p + q) == [p, q]) for i, p in enumerate(kept) for j, q in enumerate(kept))


def test_sentencepiece_query(spark, tmp_path, library):
    texts = ["a b", None, "", "  x\n\ny ", "é😀" * 3000, "the " * 30000, "a b", "▁ ▁", "z" * 50000]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pieces.op11_sentencepiece(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_codec_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (None, None, None, None)], "doc_id long, text string, ids long, _row string")
    got = pieces.decode(pieces.encode(df, pieces.model_path()), pieces.model_path())
    assert set(got.columns) == {"doc_id", "_row", "ids", "text"}
    assert {(r.doc_id, r._row, r.text) for r in got.collect()} == {(1, "x", "a b"), (None, None, "")}
    nothing = pieces.decode(spark.createDataFrame([(1, None), (2, []), (3, [2, 2])], "doc_id long, ids array<int>"), pieces.model_path())
    assert {(r.doc_id, r.text) for r in nothing.collect()} == {(1, None), (2, ""), (3, "")}
    assert pieces.encode(df.limit(0), pieces.model_path()).count() == 0


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_scan_finds_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        before = "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))
        words = sorted({before + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(2, 50))})
        want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]
        assert sorted(spelling.scan(words, len(before))) == want


def spelled(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out, form = {}, {}
    for w in n:
        of = [v for v in n if near(w, v)]
        best = min(of, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(of))
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), *out[w], None if form[w] is None else n[form[w]]) for w in n}


@pytest.mark.parametrize("bound", [2, 2000])
def test_spelling_variants(spark, bound):
    rng = random.Random(7)
    words = ["".join(rng.choice(["ab", "c", "dé", "a", "Ü"]) for _ in range(rng.randint(3, 7))) for _ in range(150)]
    words += ["x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 149, "aaaaa", "aaaaaa", *[f"aaaa{c}n" for c in "abcdef"]]
    rows = []
    for i in range(400):
        text = [rng.choice(words[: rng.choice([5, 20, len(words)])]) for _ in range(rng.randint(1, 40))]
        rows.append((i if i % 9 else None, "".join(w.title() + rng.choice([" ", "1", "-", "\n", "Œ"]) for w in text)))
    rows += [(None, None), (1, ""), rows[0], rows[0]]
    rows += [(1000 + i, f"{w} " * n) for i, (w, n) in enumerate([("kkkkkk", 40), ("kkkkkm", 12), ("kkkkmm", 4)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variants(spelling.counted(df), bound=bound)
    got = {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = spelled(rows)
    assert got == want and sum(r[2] not in (r[0], r[1]) for r in want) and sum(r[4] > 3 for r in want)


def test_spelling_variants_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.counted(df)).count() == 0


def mended(rows):
    """Least edits of (role, text) rows by keeping the best audit of every state at every place; figures as in the query but for gaps."""
    state_of = {"": 0, "s": 1, "u": 2, "a": 3}
    faults, seen = [], set()
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    turn = lambda s: "a" if s == "u" else "u"
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for s, (cost, audit, kept) in list(best.items()):
                new = (cost + 5, audit + "I", (*kept, ({"u": "user", "a": "assistant"}[turn(s)], "")))
                best[turn(s)] = min(best.get(turn(s), new), new)
        return best

    for (role, text), fault in zip(rows, faults):
        after, best = {}, insert(best)
        for s, (cost, audit, kept) in best.items():
            ways = [(s, (cost + 2, audit + "D", kept))]
            if fault in "t-":
                more = 5 * (fault == "t")
                if (s, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    ways.append((role[:1], (cost + more, audit + "K", (*kept, (role, text)))))
                ways.append((turn(s), (cost + 1 + more, audit + "R", (*kept, ({"u": "user", "a": "assistant"}[turn(s)], text)))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        best = after
    cost, audit, kept = min(v for s, v in insert(best).items() if state_of[s] in (0, 3))
    roles = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))


def by_hand(rows):
    space = lambda x: " " if x is None else x
    talks = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, space(r[2]), sha(space(r[3])))):
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        talks[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    out = {}
    for conv, rows in talks.items():
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *mended([r[1:] for r in rows]))
    return out


@pytest.mark.parametrize("most", [3, 4096])
def test_conversation_repair(spark, most):
    rng = random.Random(5)
    say = ["Yes.", "No!", "why?", "so it is", "", " \n", "a. ", "b.\x85", "c.\u2028", None, "Über.", "x" * 2000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.5:
                rows.append((conv, turn * rng.choice([1, 1, 2]), ("user", "assistant")[turn % 2], f"{rng.choice(say)} {turn}."))
            else:
                rows.append((conv, rng.choice([turn, turn, None, 3]), rng.choice(roles), rng.choice(say)))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"line {t % 40}" + "." * (t % 3 > 0)) for t in range(120)]
    rows += [(1001, 1, "user", "again.")] * 50 + [rows[0], rows[0]]
    # the only row of this one is dropped
    gone = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Lost.")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    got = {r.conv_id: tuple(r)[1:] for r in talk.repair(df, plant=True, most=most).collect()}
    want = by_hand(rows)
    assert got == want
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", sha("")) and len(want[1000][6]) > 100 and {"D", "K", "R"} <= set("".join(w[6] for w in want.values()))


def test_conversations_without_rows(spark):
    assert talk.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chunks_agree_on_costs_but_for_a_constant():
    rng = random.Random(8)
    for _ in range(500):
        n = rng.randint(2, 30)
        initials, faults = "".join(rng.choice("suaaux") for _ in range(n)), "".join(rng.choice("---bdt") for _ in range(n))
        cut = rng.randint(1, n - 1)
        true = talk.backward(initials[cut:], faults[cut:], talk.END)
        guess = talk.backward(initials[:cut], faults[:cut], talk.SPECULATIVE)
        again = talk.backward(initials[:cut], faults[:cut], true, talk.SPECULATIVE)
        assert (guess if again is None else again) == talk.backward(initials, faults, talk.END)
