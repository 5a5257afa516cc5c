"""Edge cases of all operators: nulls, repeated ids and rows, clashing names, long texts, empty tables; and verdicts by brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airexposure.llm import decontaminate, license_scan, lm_scoring, packing, quality_classifier, quality_rules, sharding, simhash_dedup, suffix_dedup, textbytes

from .test_llm import docs, prose


def test_hypergeometric_law():
    rng = np.random.default_rng(3)
    white, black, n = 300, 500, 120
    seen = np.array([sharding.hypergeometric(rng, white, black, n) for _ in range(4000)])
    mean, var = n * white / 800, n * (white / 800) * (black / 800) * (800 - n) / 799
    assert abs(seen.mean() - mean) < 4 * (var / 4000) ** 0.5 and 0.9 < seen.var() / var < 1.1
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    large = [sharding.hypergeometric(rng, 4 * 10**12, 6 * 10**12, 10**12) for _ in range(300)]
    sd = (10**12 * 0.4 * 0.6 * 0.9) ** 0.5
    assert abs(np.mean(large) - 4 * 10**11) < 4 * sd / 300**0.5 and 0.8 < np.std(large) / sd < 1.2


def test_equal_rows_are_spread_like_others(spark):
    df = spark.range(4000).select(F.when(F.col("id") >= 2000, F.col("id")).alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("slot"))
    got = sharding.shard_rows(df, 4).toPandas()
    assert list(got.columns) == ["doc_id", "shard", "slot"]
    equal = got[got.doc_id.isna()]
    assert len(equal) == 2000
    expected = 500
    assert sum((c - expected) ** 2 / expected for c in equal.groupby("shard").size()) < 16
    # neither gathered at one end of a shard nor side by side
    assert abs(equal.slot.mean() - got.slot.mean()) < 30
    ordered = got.sort_values(["shard", "slot"]).doc_id.isna().to_numpy()
    assert 0.4 < (ordered[1:] == ordered[:-1]).mean() < 0.6


def test_digests_of_shards(spark, tmp_path):
    texts = ["é", "", None, "x" * 3000, "é"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sharding.op1_hypergeometric_sharding(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_form_feeds_are_spaces(spark):
    texts = ["abc\fdeg " * 3, "xfx fff", "a\x1cb\x0bc\rd\te"]
    got = {r.doc_id: r for r in quality_rules.judged(docs(spark, texts)).collect()}
    assert [got[i].n_words for i in range(3)] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def _mcd(rows, eighth):
    """The rules' fit of one group, row by row; eighth: which rows are in the third start."""
    floors = np.array([f[1] for f in quality_rules.FEATURES.values()])

    def fit(x, factor):
        m = x.mean(0)
        return m, ((x[:, :, None] * x[:, None, :]).mean(0) - np.outer(m, m)) * factor + np.diag(floors**2)

    def step(m, c):
        d = np.einsum("ij,ij->i", rows - m, np.linalg.solve(c, (rows - m).T).T)
        bins = np.floor(np.log(np.maximum(d, 1e-6)) * quality_rules.BINS)
        last = max(b for b in np.unique(bins) if (bins < b).sum() < quality_rules.SHARE * len(rows))
        return fit(rows[bins <= last], quality_rules.CONSISTENCY)

    q = np.quantile(rows, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    fits = [(q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, floors) ** 2)), fit(rows, 1.0)]
    if eighth.any():
        fits.append(fit(rows[eighth], 1.0))
    for _ in range(quality_rules.EARLY):
        fits = [step(*f) for f in fits]
    best = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
    for _ in range(quality_rules.LATE):
        best = min([best, step(*best)], key=lambda f: np.linalg.slogdet(f[1])[1])
    return best


def test_verdicts_follow_from_the_fits(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(30, 200)) + (" #$" * rng.randint(0, 3)) for _ in range(300)] + ["# $ % " * 30 + prose(rng, 60) for _ in range(9)]
    # null language with a source and a language with null source are groups of their own
    groups = [("en", "s0"), ("en", "s1"), (None, "s0"), ("en", None), (None, "en"), (None, None)]
    rows = [(i, t, *groups[i % 6]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    assert len(got) == quality_rules.judged(df).count() == len(rows)
    features = {f: F.expr(e) for f, (e, _) in quality_rules.FEATURES.items()}
    stats = quality_rules.statistics(df).withColumns(features).withColumn("eighth", F.pmod(F.xxhash64(*features), F.lit(8)) == 0).collect()
    x = {r.doc_id: np.array([r[f] for f in quality_rules.FEATURES]) for r in stats}
    good = [i for i in x if not got[i].base_failed]

    def blend(n, own, above):
        w = n / (n + quality_rules.PRIOR)
        apart = own[0] - above[0]
        return w * own[0] + (1 - w) * above[0], w * own[1] + (1 - w) * above[1] + w * (1 - w) * np.outer(apart, apart)

    def fit(keep):
        of = [i for i in good if keep(rows[i])]
        return len(of), _mcd(np.array([x[i] for i in of]), np.array([i in third for i in of]))

    third = {r.doc_id for r in stats if r.eighth}
    _, whole = fit(lambda r: True)
    for lang, source in groups:
        n, own = fit(lambda r: r[2] == lang)
        up = blend(n, own, whole)
        n, pair = fit(lambda r: r[2:] == (lang, source))
        m, c = blend(n, pair, up)
        for i in (i for i in good if rows[i][2:] == (lang, source)):
            d = (x[i] - m) @ np.linalg.solve(c, x[i] - m)
            assert got[i].distance == pytest.approx(d) and got[i].kept == (d <= quality_rules.CUTOFF)
    assert not any(got[i].kept for i in range(300, 309)) and sum(got[i].kept for i in range(300)) > 290


def test_groups_beyond_the_broadcast_are_judged_alike(spark, monkeypatch):
    rng = random.Random(13)
    df = docs(spark, [prose(rng, rng.randint(30, 90)) for _ in range(60)] + ["# $ " * 40 + prose(rng, 30)])
    few = {r.doc_id: r.distance for r in quality_rules.judged(df).collect()}
    monkeypatch.setattr(quality_rules, "SMALL", 0)
    many = {r.doc_id: r.distance for r in quality_rules.judged(df).collect()}
    assert few == pytest.approx(many)


def test_repeats_among_rows_without_ids(spark, monkeypatch):
    rng = random.Random(21)
    shared = prose(rng, 60)
    texts = [prose(rng, 40) + shared, shared + prose(rng, 40), *[prose(rng, 70) for _ in range(8)], "twice " + prose(rng, 80)]
    rows = [(None, t) for t in [*texts, texts[-1]]] + [(None, None)]
    # all texts get the same sixteen bits beside their hash
    monkeypatch.setattr(suffix_dedup.F, "pmod", lambda *a: F.lit(5).cast("long"))
    got = Counter((r.n_bytes, r.n_removed > 0) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), 100).collect())
    assert got == Counter((len((t or "").encode()), i in (0, 1, 10, 11)) for i, (_, t) in enumerate(rows))


def test_long_texts_repeat_across_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rng = random.Random(22)
    shared = prose(rng, 70)[:250]
    texts = [prose(rng, 300) + shared + prose(rng, 400), prose(rng, 150) + shared, "x" * 300]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs(spark, texts), 200).collect()}
    assert got[0] >= 250 and got[1] >= 250 and got[2] == 300


def test_benchmark_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, 20)) for i in range(6)] + [(7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"{items[0][1]} {prose(rng, 9)}"), (1, prose(rng, 30)), (None, f"{items[1][1]} x {items[2][1]}"), (None, prose(rng, 400)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, decontaminate.contamination(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "PART_WORDS", 10)
    many = sorted(map(str, decontaminate.contamination(df, bench).collect()))
    assert one == many and len(one) == 5
    assert sorted((r.n_hit, r.items) for r in decontaminate.contamination(df, bench).collect()) == [(0, []), (0, []), (0, []), (20, ["0"]), (40, ["1", "2"])]


CLASH = ["n_words", "kept", "distance", "n_bytes", "n_chars", "_h", "_g", "_row", "row", "hits", "block", "shard", "slot", "score", "held_out", "fp", "component_id", "places", "_text", "_d", "_r", "_id", "salt", "pair", "own", "g", "k"]


def clashing(spark):
    rng = random.Random(31)
    texts = [prose(rng, 60) for _ in range(12)] + [None, "", "short"]
    df = docs(spark, texts).drop("k")
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH if c != "n_chars"}).withColumn("n_chars", F.length("text"))


def test_filtering_stages_keep_clashing_columns(spark):
    df = clashing(spark)
    bench = spark.createDataFrame([(1, "no such words here")], "item_id long, text string")
    for out in (quality_rules.drop_rejected(df), suffix_dedup.without_repeats(df), simhash_dedup.keep_first(df), decontaminate.drop_contaminated(df, bench)):
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASH if c != "n_chars")


def test_results_take_the_place_of_columns_of_their_name(spark):
    df = clashing(spark)
    bench = spark.createDataFrame([(1, "no such words here")], "item_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    outs = [
        quality_rules.judged(df), suffix_dedup.remove_repeats(df), decontaminate.contamination(df, bench), license_scan.license_matches(df), lm_scoring.lm_scores(df, df),
        quality_classifier.quality_scores(df, labels), sharding.shard_rows(df), simhash_dedup.near_duplicates(df), packing.pack_documents(df, packing.vocabulary_path()),
    ]
    for out in outs:
        assert len(set(out.columns)) == len(out.columns) and out.count() == 15


def test_empty_tables(spark):
    df = clashing(spark).limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    outs = [
        quality_rules.judged(df), quality_rules.drop_rejected(df), suffix_dedup.remove_repeats(df), suffix_dedup.without_repeats(df), decontaminate.contamination(df, bench),
        decontaminate.drop_contaminated(df, bench.limit(0)), license_scan.license_matches(df), quality_classifier.quality_scores(df, labels), simhash_dedup.near_duplicates(df), packing.pack_documents(df, packing.vocabulary_path()),
    ]
    assert all(out.count() == 0 for out in outs)


def test_long_texts_are_taken_whole(spark, monkeypatch):
    """Texts longer than the chunks that tasks work on, beside short ones."""
    rng = random.Random(41)
    texts = [prose(rng, 3000), "one two", prose(rng, 2000) + " end", None]
    df = docs(spark, texts)
    bench = spark.createDataFrame([(1, " ".join(texts[2].split()[-15:]))], "item_id long, text string")
    whole = {r.doc_id: (r.fp,) for r in simhash_dedup.near_duplicates(df).collect()}
    assert [r.n_hit for r in decontaminate.contamination(df, bench).orderBy("doc_id").collect()] == [0, 0, 15, 0]
    assert [r.n_words for r in quality_rules.judged(df).orderBy("doc_id").collect()] == [len((t or "").split()) for t in texts]
    assert {r.doc_id: (r.fp,) for r in simhash_dedup.near_duplicates(df.repartition(3)).collect()} == whole
    parts = list(textbytes.chunks(df.toArrow()["text"], 100))
    assert [p[0] for p in parts] == [0, 1, 2, 3] and [len(p[2]) for p in parts] == [len((t or "").encode()) for t in texts]


def test_pieces_without_ids_get_slots_of_their_own(spark):
    texts = ["one two", "three four", "five six", None, ""] * 6
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    for keep in (True, False):
        rows = packing.pack_documents(df, packing.vocabulary_path(), 16, keep_ids=keep).collect()
        places = [(r.sequence_id, r.offset + k) for r in rows for k in range(r.length)]
        assert len(rows) == 30 and len(places) == len(set(places))
