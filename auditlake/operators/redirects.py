"""Redirect chains over recorded answers: where each requested URL ends, after how many hops, or why the walk stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.net import broken_rule, site_of, url_of, written
from auditlake.functions.text import trim_space
from auditlake.sources.cuts import cut

# The statuses that lead on, and how many hops a page's fetch takes.
LEADING = (301, 302, 303, 307, 308)
MOST_HOPS = 3


def answer_steps(answers: DataFrame) -> DataFrame:
    """(url, step, target, site) of each answered URL (url, status, location): what it leads to, worked out once however many chains pass.

    ``step``: final, none (no location), invalid, downgrade or on. A URL with several answers counts by the least status and location.
    """
    a = answers.groupBy(written(url_of(trim_space(F.col("url")))).alias("url")).agg(F.min(F.struct("status", "location")).alias("a")).where("url is not null")
    a = a.select("url", "a.status", "a.location").withColumn("t", url_of(F.col("location"), F.col("url")))
    a = a.select("url", "status", "location", "t", broken_rule(F.col("t")).alias("broken"))
    downgrade = F.startswith("url", F.lit("https:")) & (F.col("t.scheme") == "http")
    step = (
        F.when(~F.coalesce(F.col("status").isin(*LEADING), F.lit(False)), "final").when(F.coalesce(F.col("location") == "", F.lit(True)), "none")
        .when(F.col("broken").isNotNull(), "invalid").when(downgrade, "downgrade").otherwise("on")
    )
    return a.select("url", step.alias("step"), written(F.col("t")).alias("target"), site_of(F.col("t")).alias("site"))


def follow_redirects(requests: DataFrame, answers: DataFrame, most: int = MOST_HOPS, same_origin: bool = False) -> DataFrame:
    """``requests`` (key, url) with final_url, hops and code: ``ok``, or the first reason to stop.

    Reasons, in the order in which a fetch meets them: invalid-url; network (no recorded answer); redirect-invalid (no location);
    too-many-redirects; redirect-invalid (no valid target); redirect-downgrade; redirect-invalid (another origin, where ``same_origin``). A loop ends as
    too many. ``final_url`` is the last URL asked for, null where the first was invalid. One join a hop, at most ``most`` + 1, over
    steps that are worked out once; a URL that many chains meet is a skewed key of a join, which Spark splits.
    """
    steps = cut(answer_steps(answers))
    u = url_of(trim_space(F.col("url")))
    x = requests.withColumns({"_u": u}).withColumns({"_why": broken_rule(F.col("_u"))})
    code = F.when(F.col("_why").isNotNull(), "invalid-url")
    x = x.select(*requests.columns, F.when(code.isNull(), written(F.col("_u"))).alias("final_url"), F.when(code.isNull(), site_of(F.col("_u"))).alias("_site"), F.lit(0).alias("hops"), code.alias("code"))
    for hop in range(most + 1):
        s = steps.select(F.col("url").alias("_url"), F.col("step").alias("_step"), F.col("target").alias("_target"), F.col("site").alias("_to"))
        x = x.join(s, F.coalesce(F.col("final_url"), F.lit("")) == F.col("_url"), "left")
        stop = F.when(F.col("_step").isNull(), "network").when(F.col("_step") == "final", "ok").when(F.col("_step") == "none", "redirect-invalid")
        stop = stop.otherwise("too-many-redirects") if hop == most else stop.when(F.col("_step") == "invalid", "redirect-invalid").when(F.col("_step") == "downgrade", "redirect-downgrade")
        if same_origin and hop < most:
            stop = stop.when(F.col("_to") != F.col("_site"), "redirect-invalid")
        on = F.col("code").isNull() & stop.isNull()
        x = x.select(*requests.columns, F.when(on, F.col("_target")).otherwise(F.col("final_url")).alias("final_url"), "_site", F.when(on, F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"), F.coalesce("code", stop).alias("code"))
    return x.select(*requests.columns, "final_url", "hops", "code")
