import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airexposure.llm import components, decontaminate, license_scan, lm_scoring, packing, quality_classifier, quality_rules, sharding, simhash_dedup, suffix_dedup, warc
from airexposure.llm.common import materialize

DOC = "doc_id long, text string, lang string, source string, k int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 2}", 1) for i, t in enumerate(texts)], DOC)


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ti", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_shards(spark):
    df = docs(spark, [str(i % 7) for i in range(100)] + [None])
    got = sharding.shard_rows(df, 8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == list(range(101))
    assert sorted(map(len, slots.values())) == [12] * 3 + [13] * 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(df.limit(0), 8).count() == 0
    m = sharding.communication_matrix([5, 0, 7], [4, 4, 4], 1)
    assert m.sum(0).tolist() == [4, 4, 4] and m.sum(1).tolist() == [5, 0, 7]


@pytest.mark.parametrize("length", [40, 200])
def test_suffix_dedup(spark, length):
    rng = random.Random(length)
    shared = [prose(rng, 60) for _ in range(3)]
    texts = [prose(rng, 40) + rng.choice(shared)[rng.randint(0, 50) :] + prose(rng, 30) for _ in range(12)] + [None, "", "é" * 300, "ab" * 400, shared[0], shared[0], "x"]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, texts), length).collect()}
    count = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i].kept, got[i].n_bytes, got[i].n_removed) == (kept, len(b), len(b) - len(kept))
        assert got[i].n_spans == int((gone & ~np.r_[False, gone[:-1]]).sum() if len(b) else 0)


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(0, prose(rng, 20)), (1, "Only Five-words here, yes"), (None, prose(rng, 15)), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(rng, 30) + " " + items[0][1] + " " + prose(rng, 5), "a only five words, HERE yes b", None, "", prose(rng, 500)]
    got = {r.doc_id: r for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert (got[0].n_hit, got[0].items, got[0].contaminated) == (20, ["0"], True)
    assert (got[1].n_hit, got[1].items) == (5, ["1"])
    assert (got[2].n_words, got[2].n_hit, got[2].contaminated) == (0, 0, False)
    assert got[4].n_hit == 0 and got[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.drop_contaminated(docs(spark, texts), bench).count() == 3
    index = decontaminate.postings(docs(spark, ["red x y blue", "red x x x x x x blue", "blue red"]))
    found = decontaminate.proximity_hits(index, spark.createDataFrame([(1, "red blue")], "item_id long, text string"), 4)
    near = {r.row.doc_id: len(r.hits) for r in decontaminate.by_text(index, found).collect()}
    assert near == {0: 1, 1: 0, 2: 1}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://b.example/", "<p>é</p>"), (2, "http://a.example/x?q=1", "<p>é</p>"), (3, None, None), (4, "http://a.example/a", ""), (5, "bad url\r\n", "z\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    rows = sorted(warc.merged_index(materialize(warc.read_archives(spark, str(tmp_path / "w")), "captures"), 3).collect(), key=lambda r: (r.range, r.rank))
    assert rows == sorted(rows, key=lambda r: warc._key(tuple(r)[:9]))
    got = {r.page_id: r for r in rows}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert got[1].payload_bytes == 9


def test_runs_are_merged_by_segments():
    rng = random.Random(8)
    runs = [sorted([("".join(rng.choices("abc", k=rng.randint(0, 3))), str(rng.randint(0, 9)), rng.choice([None, 1, 2]), 0, "", "", None, f"r{n}", i) for i in range(rng.randint(0, 60))], key=warc._key) for n in range(9)]
    cut = [(f"r{n}", r[i : i + 5]) for n, r in enumerate(runs) for i in range(0, len(r), 5)]
    cut.sort(key=lambda s: warc._key(s[1][0]))
    read, most = 0, 0

    def segments():
        nonlocal read
        for s in cut:
            read += len(s[1])
            yield s

    out = []
    for c in warc.merge_runs(segments()):
        out.append(c)
        most = max(most, read - len(out))
    assert out == sorted((c for r in runs for c in r), key=warc._key)
    assert most <= 5 * (len(runs) + 2)  # a segment of each run, and those just read


def test_license_scan(spark):
    wrapped = license_scan.NOTICES["mit-text"].replace(" of ", "\n# of ").replace(" and ", " and\n * ")
    texts = ["Licensed under the Apache License, Version 2.0.\nx", "some\nRELEASED under the mit license here", "cc by x all rights reserved", None, "the license", "a b c " * 30 + wrapped + " d" * 40]
    got = {r.doc_id: r for r in license_scan.license_matches(docs(spark, texts)).collect()}
    assert [m.label for m in got[0].matches] == ["apache-2.0"] and [m.label for m in got[1].matches] == ["mit"]
    assert [(p.word, p.label) for p in sorted(got[2].places)] == [(0, "cc-by"), (3, "reserved")]
    assert not got[3].matches and not got[4].matches
    assert {"mit-text", "mit-permission"} <= {m.label for m in got[5].matches}


def test_every_matching_block_is_found(spark):
    rng = random.Random(12)
    notices = {"x": "a b c d e f", "y": "a a c g h", "z": "q"}
    texts = [" ".join(rng.choice("abcdefghiq") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = {r.doc_id: r for r in license_scan.license_matches(docs(spark, texts), notices, {}, 0.6).collect()}
    for i, t in enumerate(texts):
        w, want = t.split(), {}
        for label, notice in notices.items():
            need, size = set(notice.split()), license_scan.block_words(len(notice.split()))
            shares = [len(need & set(w[k : k + size])) / len(need) for k in range(len(w))]
            if max(shares, default=0) >= 0.6 - 1e-9:
                want[label] = (max(shares), {k for k, x in enumerate(shares) if x >= 0.6 - 1e-9})
        assert {m.label for m in got[i].matches} == set(want)
        for label, (best, starts) in want.items():
            runs = [m for m in got[i].matches if m.label == label]
            assert max(m.containment for m in runs) == pytest.approx(best)
            assert {m.first for m in runs} <= starts and all(any(m.first <= k < m.end for m in runs) for k in starts)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(spark, order, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 60)  # many blocks and key ranges
    monkeypatch.setattr(lm_scoring, "RANGE", 50)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijkl") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 12))) for _ in range(40)] + ["q q q q q q q q", "", None, "a b c"] * 2
    df = docs(spark, texts)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(df, df.filter("doc_id < 25"), order, 2.0).collect()}
    words = [[*(t or "").split(), None] for t in texts]
    grams = Counter(tuple([None, *d][k - n + 1 : k + 1]) if n > 1 else (d[k - 1],) for d in words[:25] for n in range(1, order + 1) for k in range(1, len(d) + 1) if n == 1 or k - n + 1 >= 0)
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def p(history, w):
        if not history:
            return (grams[(w,)] + 1) / (n + v + 1)
        total = sum(c for g, c in grams.items() if len(g) == len(history) + 1 and g[:-1] == history)
        return (grams[(*history, w)] + 2.0 * p(history[1:], w)) / (total + 2.0)

    assert len(got) == len(texts)
    for i, d in enumerate(words):
        full = [None, *d]
        assert got[i].score == pytest.approx(sum(np.log10(p(tuple(full[max(0, k - order + 1) : k]), full[k])) for k in range(1, len(full))))
        assert got[i].base_score == pytest.approx(sum(np.log10(p((), w)) for w in d))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(d), sum(grams[(w,)] > 0 for w in d), n)
    known = {w for g in grams for w in g}
    assert sum(p((None, "a"), w) for w in known) + p((None, "a"), "unknown") == pytest.approx(1)
    assert lm_scoring.lm_scores(df.limit(0), df.limit(0)).count() == 0
    assert lm_scoring.lm_scores(df, df.limit(0)).count() == len(texts)


def test_classifier(spark):
    rng = random.Random(1)
    texts = [prose(rng, 40) if i % 2 else " ".join(w + "###" for w in prose(rng, 40).split()) for i in range(240)] + [None, ""]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(docs(spark, texts), labels).collect()
    assert len(got) == 242 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert held and sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality_rules(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(120)] + ["# " * 60 + prose(rng, 60), "one two three four five six seven eight " * 9, "short", None, "", "a\x0bb\tc\n \nx\nx"]
    got = {r.doc_id: r for r in quality_rules.judged(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams, inside = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if grams[tuple(w[k : k + 8])] > 1:
                inside.update(range(k, k + 8))
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
        assert got[i].n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
    assert not got[120].kept and not got[121].kept and not got[123].kept
    assert all(got[i].kept or got[i].base_failed for i in range(120))


def test_pipeline_ends_with_token_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["a red fox", "a red fox", None, "", "one two three " * 2000, "a blue fox 12"]
    df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id") % 2))
    got = corpus_pipeline.best_fit_packing(spark, df, "").collect()
    want = Counter(tuple(ids[k : k + 4096]) for x in texts for ids in [t.encode(x or "", add_special_tokens=False).ids + [1]] for k in range(0, len(ids), 4096))
    assert Counter(tuple(r.ids) for r in got) == want
    taken = defaultdict(set)
    for r in got:
        place = set(range(r.offset, r.offset + len(r.ids)))
        assert len(r.ids) == r.length and max(place) < 4096 and not place & taken[r.sequence_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        taken[r.sequence_id] |= place


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    t = Tokenizer.from_file(path)
    texts = ["it's a<|endoftext|>B <|ENDOFTEXT|>", "a≠b é x́, İstanbul, 12ab3 ''s don't I'LL — ü— «a» ×÷\x0b\x85 ǅ", None, "", "日本語 😀!! Σίσυφος ΑΣ'", "x " * 100]
    got = packing.pack_documents(docs(spark, texts), path, 16, keep_ids=True).collect()
    ids, room = defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        ids[r.doc_id] += r.ids
        room[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    assert {i: ids[i] for i in range(len(texts))} == {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 16


def test_plan_covers_all_ranks():
    rng = random.Random(5)
    sizes = Counter(rng.randint(1, 50) for _ in range(3000))
    load, seen = Counter(), Counter()
    for size, lo, hi, first, offset, per in packing.plan(dict(sizes), 64):
        for r in range(lo, hi):
            load[first + (r - lo) // per] += size
            seen[size] += 1
    assert seen == sizes and max(load.values()) <= 64
    assert len(load) <= 1.03 * sum(k * n for k, n in sizes.items()) / 64 + 1


def test_simhash(spark):
    rng = random.Random(4)
    base = [prose(rng, 80) for _ in range(20)]
    texts = base + [b + " end" for b in base[:10]] + [base[0]] * 5 + [None, "", "one two", "One  TWO"]
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs(spark, texts)).collect()}
    fps = np.array([got[i].fp for i in range(len(texts))], dtype=np.int64).view(np.uint64)
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            root[i] = min(root[j] for j in range(len(texts)) if bin(int(fps[i] ^ fps[j])).count("1") <= 2)
    assert [got[i].component_id for i in range(len(texts))] == root
    assert got[35].fp == got[36].fp == 0 and got[37].fp == got[38].fp


def test_dense_fingerprints_take_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "MIDPOINTS", 0)
    rng = random.Random(6)
    values = [rng.getrandbits(63) for _ in range(40)]
    values += [v ^ (1 << rng.randint(0, 62)) ^ (1 << rng.randint(0, 62)) for v in values[:20]]
    df = spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long")
    edges = simhash_dedup.link_fingerprints(df)
    assert edges.filter("not mid").count() == 0
    roots = {r.node: r.root for r in components.connected_components(edges.select("a", "b")).collect()}
    for a in values:
        for b in values:
            assert (roots[a] == roots[b]) >= (bin(a ^ b).count("1") <= 2)


def test_allocation_is_cheapest():
    costs = [[np.array([0.0]), np.array([c]), np.array([3 * c]), np.array([9 * c])] for c in (5.0, 1.0, 2.0)]
    picked, cost = simhash_dedup.allocate(costs, 2)
    assert picked.ravel().tolist() == [-1, 1, 0] and cost[0] == 5.0


def test_partitions_follow_from_the_number_of_fingerprints():
    assert [simhash_dedup.parts_for(n) for n in (0, 10**5, 10**9, 10**10)] == [3, 3, 2, 2]
    # at a thousand million fingerprints the pigeonhole search still is cheaper than the midpoints
    sizes = [32, 32]
    costs = [[np.array([0.0]), *[np.array([len(simhash_dedup._flips(s, t)) * (0.1 + 1e9 / 2.0**s)]) for t in range(3)]] for s in sizes]
    assert simhash_dedup.allocate(costs, 2)[1][0] < simhash_dedup.MIDPOINTS


@pytest.mark.parametrize("partitions", [2, 3])
def test_partitions_find_the_same_links(spark, partitions):
    rng = random.Random(14)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(2):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash_dedup.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), partitions=partitions).collect()
    assert not any(r.mid for r in edges)
    got = {frozenset((r.a, r.b)) for r in edges}
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_words_do_not_cross_texts():
    from airexposure.llm.textbytes import SPACE_WORDS, chunks, words

    (_, offsets, data), = chunks(pa.array(["ab", "cd e", None, ""]))
    starts, ends, first = words(data, offsets, SPACE_WORDS)
    assert list(zip(starts, ends)) == [(0, 2), (2, 4), (5, 6)] and first.tolist() == [0, 1, 3, 3, 3]


def test_keep_first_of_repeated_and_missing_ids(spark):
    a, b = "one two three four five six seven", "red green blue black white grey pink"
    rows = [(1, a), (1, a), (2, a.upper()), (3, b), (4, None), (5, ""), (None, a), (None, a), (None, b)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, c long")
    out = simhash_dedup.keep_first(docs).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [1, 3, 4]
    assert sorted(r["text"] for r in out if r["doc_id"] is None) == sorted([a, b])
    assert simhash_dedup.keep_first(docs.limit(0)).count() == 0


def test_keep_first_goes_by_rows(spark):
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    # 2 has a copy of 1 and a text of its own; 3 stands twice, with two texts; rows without id: near copies of each other and of 1
    rows = [(1, a), (2, a.upper()), (2, b), (3, c), (3, d), (3, d), (None, a.title()), (None, a), (None, "x " + prose(rng, 80))]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, c long")
    out = simhash_dedup.keep_first(docs).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id is not None) == sorted([(1, a), (2, b), (3, c), (3, d)])
    assert len([r for r in out if r.doc_id is None and r.text.lower() == a]) == 1 and len(out) == 6
