"""A whole run of the pipeline and the substring query against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from airexposure.llm import packing, suffix_dedup

SPACES = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ti", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def passes_rules(text):
    w = re.findall(SPACES, text or "")
    grams, inside = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
    for k in range(len(w) - 7):
        if grams[tuple(w[k : k + 8])] > 1:
            inside.update(range(k, k + 8))
    return len(w) >= 20 and 100 * len(inside) <= 30 * len(w)


def fingerprint(text):
    w = re.findall(SPACES, low(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def first_of_each(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = [i for i, _ in rows]
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in range(len(rows))]
    return [(i, t) for (i, t), r in zip(rows, root) if i == r]


def without_repeats(rows, length=200):
    raw = [t.encode() for _, t in rows]
    count = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode()))
    return out


def is_contaminated(text, items):
    w, hit = re.findall(LETTERS, low(text)), set()
    for item in items:
        q = re.findall(LETTERS, low(item))
        for window in [q[k : k + 13] for k in range(max(1, len(q) - 12))] if q else []:
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_whole_run(spark, tmp_path):
    rng = random.Random(12)
    shared, asked = prose(rng, 70), prose(rng, 30)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(90)]
    texts[5] = texts[5] + " " + shared + " " + prose(rng, 90)
    texts[9] = prose(rng, 80) + " " + shared + " " + texts[9]
    texts[11] = prose(rng, 40) + " " + asked.upper() + " " + prose(rng, 40)
    texts[20] = texts[21].title()
    texts += [texts[3]] * 6 + [None, "", "too short", "one two three four five six seven eight " * 9]
    # within the fixed limits, but far from all others
    outlier = len(texts)
    texts.append(" ".join(f"{w}#$%&" for w in prose(rng, 80).split()))
    rows = list(enumerate(texts))
    docs = [(i, t, "en" if i % 5 else None, None if i % 7 == 0 else "web" if i % 3 else "hot", len(t or ""), f"extra {i}") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", asked), ("b2", None), ("b3", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert passes_rules(texts[outlier])
    want = first_of_each([(i, t) for i, t in rows if passes_rules(t) and i != outlier])
    assert len(want) == 89 and 20 in dict(want) and 21 not in dict(want)
    want = without_repeats(want)
    assert not any(shared in t for _, t in want)
    want = [(i, t) for i, t in want if not is_contaminated(t, [asked, None, ""])]
    assert len(want) == 88 and 11 not in dict(want)
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in want}

    got = defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.piece):
        got[r.doc_id] += list(r.ids)
    assert dict(got) == ids


def test_substring_sql_agrees(spark, tmp_path):
    rng = random.Random(13)
    shared = prose(rng, 90)
    texts = [prose(rng, 50) + shared[rng.randint(0, 60) :] + "é" * rng.randint(0, 9) + prose(rng, 20) for _ in range(8)] + [shared, shared, "ab" * 300, "ü" * 150, None, "", "x"]
    spark.createDataFrame([(i % 13, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, str(tmp_path)).select(*names).collect())
    assert got == sorted(con.sql(suffix_dedup.ORACLE_SQL).select(*names).fetchall())
    assert sum(r[2] for r in got) > 1000
    assert any(r[4] == hashlib.sha256(b"").hexdigest() for r in got)
