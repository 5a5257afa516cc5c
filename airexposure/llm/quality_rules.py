"""Quality rules: fixed limits first, then robust multivariate outliers per language and source. DataFrame and SQL functions only.

``statistics`` counts, per text, words, characters, symbols, repeated lines and repeated 8-word windows; every text is read
once and only its counts are written out. ``mcd`` estimates each group's centre and scatter by the minimum covariance
determinant: from three starts (medians and quartiles; all rows; an eighth of the rows by hash), concentration steps refit
mean and covariance on the three quarters of the rows that are nearest so far, and the fit with the least determinant is
kept. Distances are counted in fixed log-scale bins, so the nearest rows are found by sums over a few hundred bins for each
group instead of sorting it. Rows whose Mahalanobis distance exceeds the cutoff are rejected.

Fits are made for all rows, each language, and each language and source; each takes over from the one above it with weight
n / (n + PRIOR), so a small group is judged mostly as its language is, and no group size changes the rule. A null text has
no words and fails the fixed limits; null lang or source is a group of its own (null lang with a source and a lang with null
source are two); repeated rows count each; ties in distance
fall into one bin; empty input gives no rows. Other columns pass through: ``judged`` leaves out those called like its
results, ``drop_rejected`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, materialize, read, row_without

SPACE = r"[\\x20\\x09-\\x0D]+"
#: Transformed statistics and the least standard deviation that each is given.
FEATURES = {
    "f_length": ("ln((word_chars + 150) / (n_words + 30))", 0.06),
    "f_symbols": ("sqrt(n_symbols / (word_chars + 150))", 0.05),
    "f_capitals": ("sqrt(n_capitals / (word_chars + 150))", 0.07),
    "f_lines": ("sqrt(n_dup_lines / (n_lines + 3))", 0.15),
    "f_repeats": ("sqrt(n_repeat_words / (n_words + 30))", 0.12),
}
#: For 5 statistics: chi-square quantiles of 3/4 and 1e-6, and the factor that makes the covariance of the nearest 3/4 consistent.
SHARE, CONSISTENCY, CUTOFF = 0.75, 1.41, 35.9
BINS = 32  # to a factor e of squared distance
EARLY, LATE = 2, 2  # concentration steps of all starts, and of the best one
PRIOR = 50  # rows that the fit of the group above counts for
SMALL = 10_000  # groups whose fits are broadcast (some 300 bytes each); beyond, rows meet them by a salted join
_D = len(FEATURES)
_CELLS = [(i, j) for i in range(_D) for j in range(i + 1)]
_FIT = [f"m{i}" for i in range(_D)] + [f"c{i}{j}" for i, j in _CELLS]


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words() -> str:
    """SQL over w (array of words): words inside 8-word windows that stand twice or more."""
    window = ", ".join(f"hw[i + {k}]" if k else "hw[i]" for k in range(8))
    hashes = f"if(size(w) < 8, array(), transform(sequence(0, size(w) - 8), i -> xxhash64({window})))"
    twice = "filter(transform(s, (x, k) -> if((k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(s) and s[least(k + 1, size(s) - 1)].h = x.h), x.i, -1)), p -> p >= 0)"
    covered = f"aggregate(array_sort({twice}), named_struct('c', 0L, 'e', 0L), (a, p) -> named_struct('c', a.c + p + 8 - greatest(cast(p as bigint), a.e), 'e', cast(p + 8 as bigint)), a -> a.c)"
    counted = _let("array_sort(transform(g, (h, i) -> named_struct('h', h, 'i', i)))", "s", covered)
    return _let("transform(w, x -> xxhash64(x))", "hw", _let(hashes, "g", f"if(size(array_distinct(g)) = size(g), 0L, {counted})"))


def statistics(rows: DataFrame) -> DataFrame:
    """rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals (all long) in place of text."""
    others = [c for c in rows.columns if c != "text"]
    text = rows.select(*others, F.coalesce("text", F.lit("")).alias("t"))
    # splitting at one character is several times faster than at a pattern, which only texts with rarer white space need
    rare = " or ".join(f"contains(t, '{c}')" for c in (r"\t", r"\u000b", r"\u000c", r"\r"))
    words = rf"filter(if({rare}, split(t, '{SPACE}'), split(replace(t, '\n', ' '), ' ')), x -> x <> '')"
    counts = _let(words, "w", f"named_struct('n_words', cast(size(w) as bigint), 'word_chars', aggregate(w, 0L, (a, x) -> a + length(x)), 'n_repeat_words', {_repeat_words()})")
    lines = _let(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')", "l", "named_struct('n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint))")
    marks = _let("regexp_replace(t, '[^A-Z#*$%&|<>]+', '')", "r", "named_struct('n_marks', cast(length(r) as bigint), 'n_capitals', cast(length(regexp_replace(r, '[^A-Z]+', '')) as bigint))")
    out = text.select(*others, F.expr(counts).alias("_w"), F.expr(lines).alias("_l"), F.expr(marks).alias("_m"))
    return out.select(*others, "_w.n_words", "_w.word_chars", (F.col("_m.n_marks") - F.col("_m.n_capitals")).alias("n_symbols"), "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "_m.n_capitals")


def _distance() -> Column:
    """Squared Mahalanobis distance from columns m0.. (centre) and l00.. (Cholesky factor), by forward substitution."""
    z: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _factored(fits: DataFrame) -> DataFrame:
    """Fits with the Cholesky factor l00.. of their covariances c00.. and the logarithm of their determinant."""
    for i, j in _CELLS:
        v = F.col(f"c{i}{j}")
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        fits = fits.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    return fits.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(1, _D)), F.log("l00")))


def _fit(near: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Mean and covariance (times factor, plus the least variances) of the rows of each key."""
    names, floors = list(FEATURES), [f[1] for f in FEATURES.values()]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}{j}") for i, j in _CELLS]
    sums = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("h"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(names)], *products)
    means = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("h") for i in range(_D)})
    cov = [((F.col(f"q{i}{j}") / F.col("h") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _CELLS]
    return means.select(*keys, *[f"m{i}" for i in range(_D)], *cov)


def _meet(rows: DataFrame, fits: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows (g, salt, ...) with the fits of their group, by broadcast if these are few, else by an equi-join in which hot groups are split."""
    if few:
        return rows.join(F.broadcast(fits), "g", how)
    salts = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(buckets_for(rows.sparkSession) - 1))))
    return rows.join(salts, ["g", "salt"], how)


def _concentrated(rows: DataFrame, fits: DataFrame, few: bool) -> DataFrame:
    """One concentration step of each fit (g, start): refitted on the nearest SHARE of the group's rows."""
    placed = _meet(rows, _factored(fits), few).withColumn("bin", F.floor(F.log(F.greatest(_distance(), F.lit(1e-6))) * BINS).cast("int"))
    sizes = placed.groupBy("g", "start", "bin").count()
    w = Window.partitionBy("g", "start")  # a few hundred bins for each
    before = F.sum("count").over(w.orderBy("bin")) - F.col("count")
    cut = sizes.withColumns({"_before": before, "_n": F.sum("count").over(w)}).filter(F.col("_before") < SHARE * F.col("_n")).groupBy("g", "start").agg(F.max("bin").alias("last"))
    joined = _meet(rows, _factored(fits.join(cut, ["g", "start"])), few)
    near = joined.filter(F.floor(F.log(F.greatest(_distance(), F.lit(1e-6))) * BINS).cast("int") <= F.col("last"))
    return _fit(near, CONSISTENCY, "g", "start")


def _best(fits: DataFrame) -> DataFrame:
    """The fit with the least determinant of each group, the first start of equals."""
    one = F.min(F.struct("logdet", "start", *_FIT)).alias("b")
    return _factored(fits).groupBy("g").agg(one).select("g", *[F.col(f"b.{c}").alias(c) for c in _FIT])


def mcd(rows: DataFrame, few: bool = False) -> DataFrame:
    """rows (g, salt, FEATURES): one row for each group g, with its robust centre m0.. and covariance c00..; few: at most SMALL groups."""
    names, floors = list(FEATURES), [f[1] for f in FEATURES.values()]
    quartiles = rows.groupBy("g").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 10000).alias(f"p{i}") for i, f in enumerate(names)])
    width = [F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(floors[i])) for i in range(_D)]
    middle = quartiles.select("g", *[F.col(f"p{i}")[1].alias(f"m{i}") for i in range(_D)], *[(width[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _CELLS])
    starts = [middle, _fit(rows, 1.0, "g"), _fit(rows.filter(F.pmod(F.xxhash64(*names), F.lit(8)) == 0), 1.0, "g")]
    now = None
    for k, fits in enumerate(starts):
        fits = fits.withColumn("start", F.lit(k))
        now = fits if now is None else now.unionByName(fits)
    now = materialize(now, "mcd")
    for _ in range(EARLY):
        now = materialize(_concentrated(rows, now, few), "mcd")
    now = materialize(_best(now).withColumn("start", F.lit(0)), "mcd")
    for k in range(LATE):
        now = materialize(_best(now.unionByName(_concentrated(rows, now, few).withColumn("start", F.lit(k + 1)))).withColumn("start", F.lit(0)), "mcd")
    return now.drop("start")


def _blended(own: DataFrame, above: DataFrame) -> DataFrame:
    """own (g, n, up, fit) taking over from the fit of the group ``up`` with weight n / (n + PRIOR): mean and covariance of the mixture."""
    a = above.select(F.col("g").alias("up"), *[F.col(c).alias(f"_{c}") for c in _FIT])
    both = own.join(a, "up").withColumn("_w", F.col("n") / (F.col("n") + F.lit(PRIOR)))
    mix = {c: F.col("_w") * F.col(c) + (1 - F.col("_w")) * F.col(f"_{c}") for c in _FIT}
    for i, j in _CELLS:
        apart = (F.col(f"m{i}") - F.col(f"_m{i}")) * (F.col(f"m{j}") - F.col(f"_m{j}"))
        mix[f"c{i}{j}"] = mix[f"c{i}{j}"] + F.col("_w") * (1 - F.col("_w")) * apart
    return both.select("g", "n", *[mix[c].alias(c) for c in _FIT])


def _group_id(level: int, *keys: str) -> Column:
    """64 bits for the group of the keys' values; the hash skips nulls, so it takes whether each key is null as well."""
    return F.xxhash64(F.lit(level), *[c for k in keys for c in (F.col(k).isNull(), F.col(k))])


def _judge(rows: DataFrame, cutoff: float) -> DataFrame:
    """rows (_row, text, lang, source) to _row, the statistics, base_failed, kept and distance."""
    stats = materialize(statistics(rows), "statistics")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(buckets_for(rows.sparkSession))).cast("int")
    keys = {"base_failed": base, "pair": _group_id(2, "lang", "source"), "own": _group_id(1, "lang"), "salt": salt}
    every = stats.withColumns(keys).withColumns({f: F.expr(e) for f, (e, _) in FEATURES.items()})
    good = every.filter("not base_failed")
    levels = materialize(good.select("salt", *FEATURES, F.explode(F.array("pair", "own", F.lit(0).cast("long"))).alias("g")), "levels")
    counts = materialize(good.groupBy("pair", "own").count(), "counts")
    few = 2 * counts.count() < SMALL  # of pairs, languages and the whole
    fits = mcd(levels, few)
    of_pair = counts.select(F.col("pair").alias("g"), F.col("own").alias("up"), F.col("count").alias("n"))
    of_lang = counts.groupBy(F.col("own").alias("g")).agg(F.sum("count").alias("n")).withColumn("up", F.lit(0).cast("long"))
    langs = _blended(of_lang.join(fits, "g"), fits.filter("g = 0"))
    pairs = materialize(_factored(_blended(of_pair.join(fits, "g"), langs)).drop("n", "logdet", *[c for c in _FIT if c[0] == "c"]), "groups")
    out = _meet(every.withColumn("g", F.col("pair")), pairs, few, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return out.select("_row", *RESULTS[:5], "base_failed", kept.alias("kept"), "distance")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs without text, with the statistics, base_failed, kept and distance (squared; null where the fixed limits decide)."""
    return _judge(docs.select(row_without(docs, "text", *RESULTS).alias("_row"), "text", "lang", "source"), cutoff).select("_row.*", *RESULTS)


def drop_rejected(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs without the rejected texts; all columns kept."""
    rows = docs.select(row_without(docs).alias("_row"), "text", "lang", "source")
    return _judge(rows, cutoff).filter("kept").select("_row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", *RESULTS)
