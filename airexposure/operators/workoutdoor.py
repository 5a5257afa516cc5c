"""Probability that a worker is outdoors, from occupation and industry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged


def soc_code(c: Column) -> Column:
    """NN-NNNN, without a trailing .00; anything else is null."""
    text = F.regexp_replace(F.trim(c), r"\.00$", "")
    return F.when(text.rlike(r"^[0-9]{2}-[0-9]{4}$"), text)


def number(c: Column) -> Column:
    """Number without thousands separators; marks for missing values are null."""
    text = F.regexp_replace(F.trim(c), ",", "")
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"), text).try_cast("double")


def industry_group(c: Column) -> Column:
    """struct(grp, reason) of an industry text."""
    text = F.lower(F.trim(c))
    digits = F.regexp_extract(text, "([0-9]{2,6})", 1)
    combined = F.when(text.startswith("naics31_33"), "31_33").when(text.startswith("naics44_45"), "44_45").when(text.startswith("naics48_49"), "48_49")
    grp = F.when(text.isNull() | (text == "nan") | (text == "not_working") | (text == ""), None).when(combined.isNotNull(), combined).when(digits != "", F.substring(digits, 1, 2))
    reason = F.when(text.isNull() | (text == "nan") | (text == ""), "missing").when(text == "not_working", "not_working").when(grp.isNull(), "unparsed").otherwise("ok")
    return F.struct(grp.alias("grp"), reason.alias("reason"))


def soc_shares(onet: DataFrame, elements: list, scale: str = "CXP", least: int = 4, combine: str = "union") -> DataFrame:
    """(soc, share): outdoor share of each occupation that has all elements."""
    rows = onet.filter((F.col("scale_id") == scale) & F.col("element").isin(elements)).withColumn("soc", soc_code(F.col("soc"))).filter("soc is not null")
    each = rows.groupBy("soc").pivot("element", elements).agg(F.sum(F.when(F.col("category") >= least, F.col("value")).otherwise(0.0)) / 100)
    parts = [F.col(f"`{e}`") for e in elements]
    for p in parts:
        each = each.filter(p.isNotNull())
    if combine == "mean":
        return each.select("soc", (sum(parts[1:], parts[0]) / len(parts)).alias("share"))
    rest = F.lit(1.0)
    for p in parts:
        rest = rest * (1 - p)
    return each.select("soc", (1 - rest).alias("share"))


def sector_weights(oews: DataFrame) -> DataFrame:
    """(sector, soc, employment, total): detailed groups only; total is the sector's.

    Cells are parsed once for all rows that are alike, which are counted and staged: else the conditions on what is parsed go below the count.
    """
    alike = staged(oews.filter("o_group = 'detailed'").groupBy("naics", "soc", "tot_emp").agg(F.count(F.lit(1)).alias("_rows")), "occupations")
    rows = alike.select(F.substring("naics", 1, 2).alias("sector"), soc_code(F.col("soc")).alias("soc"), number(F.col("tot_emp")).alias("e"), "_rows").filter("soc is not null and e is not null")
    each = rows.groupBy("sector", "soc").agg(F.sum(F.col("e") * F.col("_rows")).alias("employment"))
    return each.join(each.groupBy("sector").agg(F.sum("employment").alias("total")), "sector")


def sector_probabilities(weights: DataFrame, shares: DataFrame) -> DataFrame:
    """(sector, p_outdoor, total): weights are not rescaled to the occupations that have a share."""
    both = weights.join(shares, "soc")
    return both.groupBy("sector").agg(F.sum(F.col("employment") / F.col("total") * F.col("share")).alias("p_outdoor"), F.max("total").alias("total"))


def assign(persons: DataFrame, sectors: DataFrame) -> DataFrame:
    """(person_id, grp, reason, p_outdoor): combined groups take the employment-weighted mean of the sectors that they span."""
    rows = persons.select("person_id", industry_group(F.col("industry")).alias("i")).select("person_id", "i.*")
    # groups are parsed from the distinct industries, which are staged: else the parsing is planned over all persons again, in a method too large to be compiled
    spans = staged(persons.select("industry").distinct(), "industries").select(industry_group(F.col("industry")).alias("i")).select("i.grp").filter("grp is not null").distinct()
    lo, hi = F.split("grp", "_")[0].cast("int"), F.when(F.col("grp").contains("_"), F.substring_index("grp", "_", -1)).otherwise(F.col("grp")).cast("int")
    each = spans.withColumn("sector", F.explode(F.sequence(lo, hi))).withColumn("sector", F.col("sector").cast("string"))
    p = each.join(sectors, "sector").groupBy("grp").agg((F.sum(F.col("p_outdoor") * F.col("total")) / F.sum("total")).alias("p_outdoor"))
    out = rows.join(p, "grp", "left")
    missing = F.when(F.col("grp").contains("_"), "unmapped_combined_group").otherwise("sector_not_covered")
    reason = F.when((F.col("reason") == "ok") & F.col("p_outdoor").isNull(), missing).otherwise(F.col("reason"))
    return out.select("person_id", "grp", reason.alias("reason"), "p_outdoor")


def match_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(matched, unmatched): rows of left whose key is among right's, and the others."""
    both = left.select(key).join(right.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return both.agg(F.count_if(F.col("_in").isNotNull()).alias("matched"), F.count_if(F.col("_in").isNull()).alias("unmatched"))


def with_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (grp) with the sector's label: labels are (grp, label), one a sector."""
    return rows.join(labels, "grp", "left")


def missingness(onet: DataFrame, oews: DataFrame, shares: DataFrame, weights: DataFrame, assigned: DataFrame) -> DataFrame:
    """(step, metric, value): what each step of the model read, kept and could not use."""

    def counted(step: str, rows: DataFrame, **metrics: Column) -> DataFrame:
        one = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in metrics.items()])
        return one.select(F.lit(step).alias("step"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*one.columns))).alias("metric", "value"))

    matched = match_counts(weights, shares, "soc")
    reasons = assigned.groupBy(F.lit("assign").alias("step"), F.col("reason").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    parts = [
        counted("onet", onet, bad_soc=soc_code(F.col("soc")).isNull(), no_value=F.col("value").isNull()),
        counted("oews", oews, not_detailed=F.coalesce(F.col("o_group") != "detailed", F.lit(True)), no_employment=number(F.col("tot_emp")).isNull()),
        counted("shares", shares), counted("weights", weights),
        matched.select(F.lit("match").alias("step"), F.explode(F.create_map(F.lit("matched"), F.col("matched"), F.lit("unmatched"), F.col("unmatched"))).alias("metric", "value")),
        reasons,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def work_outdoor(persons: DataFrame, onet: DataFrame, oews: DataFrame, elements: list, scale: str = "CXP", least: int = 4, combine: str = "union") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, sectors, missingness) of persons (person_id, industry) and the two occupation tables."""
    shares = soc_shares(onet, elements, scale, least, combine)
    weights = sector_weights(oews)
    sectors = sector_probabilities(weights, shares)
    assigned = assign(persons, sectors)
    return assigned, sectors, missingness(onet, oews, shares, weights, assigned)
