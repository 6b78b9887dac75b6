"""Weighted scores of categories: unknown stays apart from zero, and what doesn't apply carries no weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.text import round_half_up

#: Category, weight, step, layer, in rubric order.
RUBRIC = [
    ("agent-discovery", 18, "find", "survival"),
    ("machine-readable-structure", 18, "understand", "survival"),
    ("access-renderability", 18, "understand", "survival"),
    ("form-semantics", 16, "act", "survival"),
    ("actionability", 15, "act", "survival"),
    ("webmcp-capability", 15, "act", "superpower"),
]
SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


#: Categories that were registered beside those above: weight, step, layer by category.
MORE: dict[str, tuple[int, str, str]] = {}


def rubric_rows() -> list[tuple[str, int, str, str]]:
    return [*RUBRIC, *((category, *rest) for category, rest in MORE.items())]


def rubric(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(rubric_rows())]
    return spark.createDataFrame(rows, "ord int, category string, weight int, step string, layer string")


def letter_grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").when(score.isNotNull(), "F")


def with_rubric(results: DataFrame) -> DataFrame:
    """Every page by every category; one without a result applies, unscored."""
    dim = F.broadcast(rubric(results.sparkSession))  # six rows
    pages = results.select("page_id").distinct().crossJoin(dim)
    joined = pages.join(results, ["page_id", "category"], "left")
    return joined.withColumn("applicable", F.coalesce("applicable", F.lit(True)))


def mean_of(weighted: Column, weight: Column) -> Column:
    """Rounded half up; null without weight."""
    return round_half_up(F.try_divide(weighted, F.nullif(weight, F.lit(0))))


def looked_up(place: int) -> Column:
    """A category's weight (1) or layer (3), null for one outside the rubric."""
    return F.create_map(*[F.lit(x) for r in rubric_rows() for x in (r[0], r[place])])[F.col("category")]


def summarize(results: DataFrame) -> DataFrame:
    """One row a page from rows (page_id, category, applicable, score); a category without a row applies, unscored.

    One aggregation: the categories that are there are bits of a mask, and those that lack add what an unscored one would.
    """
    bits = F.create_map(*[F.lit(x) for i, r in enumerate(rubric_rows()) for x in (r[0], 1 << i)])[F.col("category")]
    r = results.select("page_id", "category", F.coalesce("applicable", F.lit(True)).alias("on"), "score", looked_up(1).alias("weight"), looked_up(3).alias("layer"), bits.alias("bit")).where("weight is not null")
    w, on, s, power = F.col("weight"), F.col("on"), F.col("score"), F.col("layer") == "superpower"
    known = on & s.isNotNull()
    total = lambda when, what: F.sum(F.when(when, what).otherwise(0))
    g = r.groupBy("page_id").agg(
        total(known, w * s).alias("ws"), total(known, w).alias("kw"), total(on, w).alias("ow"), total(known & ~power, w * s).alias("sws"), total(known & ~power, w).alias("skw"),
        F.max(F.when(power & on, s)).alias("superpower"), total(power & on, w).alias("pw"), F.bool_or(power & on & (F.coalesce(s, F.lit(0)) < 100)).alias("open"), F.bit_or("bit").alias("seen"),
    )
    lacking = [(F.col("seen").bitwiseAND(F.lit(1 << i)) == 0, r[1], r[3] == "superpower") for i, r in enumerate(rubric_rows())]
    more = sum((F.when(c, weight).otherwise(0) for c, weight, _ in lacking), F.lit(0))
    more_power = sum((F.when(c, weight).otherwise(0) for c, weight, p in lacking if p), F.lit(0))
    overall = mean_of(F.col("ws"), F.col("kw"))
    coverage = F.coalesce(F.try_divide(F.col("kw").cast("double"), F.col("ow") + more), F.lit(0.0))
    full = mean_of(F.col("sws") + 100 * (F.col("pw") + more_power), F.col("skw") + F.col("pw") + more_power)
    chance = F.when(overall.isNotNull() & (F.coalesce("open", F.lit(False)) | (more_power > 0)), full)
    return g.select(
        "page_id", overall.alias("overall"), letter_grade(overall).alias("grade"), (F.floor(coverage * 100 + 0.5) / 100).alias("coverage"),
        mean_of(F.col("sws"), F.col("skw")).alias("survival"), "superpower", chance.alias("opportunity"),
    )


def category_weights(results: DataFrame) -> DataFrame:
    """Each category's share of the applicable weight, in percent to one place."""
    r = with_rubric(results)
    total = F.sum(F.when(F.col("applicable"), F.col("weight"))).over(Window.partitionBy("page_id"))
    share = F.when(F.col("applicable"), F.floor(F.col("weight") / total * 1000 + 0.5) / 10).otherwise(F.lit(0.0))
    return r.select("page_id", "category", share.alias("effective_weight"))


def step_states(results: DataFrame) -> DataFrame:
    """A lamp for each page and step: the unrounded mean of known scores."""
    r = with_rubric(results)
    known = F.col("applicable") & F.col("score").isNotNull()
    mean = F.try_divide(F.sum(F.when(known, F.col("weight") * F.col("score"))), F.sum(F.when(known, F.col("weight"))))
    out = r.groupBy("page_id", "step").agg(mean.alias("mean"))
    lamp = F.when(F.col("mean").isNull(), "off").when(F.col("mean") >= 75, "pass").when(F.col("mean") >= 40, "warn").otherwise("fail")
    return out.select("page_id", "step", lamp.alias("state"))


def opportunity_labels(summary: DataFrame) -> DataFrame:
    """What full marks in the superpower layer would add; null where nothing."""
    gain = F.col("opportunity") - F.col("overall")
    return summary.select("page_id", F.when(gain > 0, F.concat(F.lit("+"), gain.cast("string"), F.lit(" to "), F.col("opportunity").cast("string"))).alias("label"))


def rank_findings(findings: DataFrame) -> DataFrame:
    """Actionable findings of (page_id, category, ord, id, severity, positive), the most weighty first."""
    dim = F.broadcast(rubric(findings.sparkSession).withColumnRenamed("ord", "rubric_ord"))
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    real = findings.where(~F.coalesce("positive", F.lit(False)) & ~F.endswith("id", F.lit(".unobserved")))
    scored = real.join(dim, "category").withColumn("priority", rank[F.col("severity")] * F.col("weight"))
    order = Window.partitionBy("page_id").orderBy(F.desc("priority"), "rubric_ord", "ord")
    return scored.withColumn("rank", F.row_number().over(order)).select("page_id", "category", "id", "severity", "priority", "rank")


def top_findings(findings: DataFrame, k: int = 3) -> DataFrame:
    return rank_findings(findings).where(F.col("rank") <= max(k, 0))
