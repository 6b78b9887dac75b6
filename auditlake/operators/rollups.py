"""Audits summed up over many pages: every grouping of grade, host and step in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.net import host
from auditlake.operators import scoring


def audit_cube(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(grade, host, step, level, pages, passed, mean): all groupings of ``results`` by the page's grade, its host (``pages``: page_id, url) and the step.

    ``level`` tells the grouping: 4, 2 and 1 stand for a grade, host or step that is summed over (null then; a page without a grade or host has null
    in its own grouping). ``pages`` counts pages, ``passed`` lamps that stand at pass, ``mean`` is the mean overall score of scored pages to one place. One
    shuffle of partial sums for all groupings: rows are a page and step, so each page counts once for each step it is seen at.
    """
    s = scoring.summarize(results).select("page_id", "grade", "overall")
    rows = scoring.step_states(results).join(s, "page_id").join(pages.select("page_id", host(F.col("url")).alias("host")), "page_id")
    steps = len({r[2] for r in scoring.rubric_rows()})
    seen = F.when(F.grouping("step") == 1, F.count("*") / steps).otherwise(F.count("*"))
    return rows.cube("grade", "host", "step").agg(
        F.grouping_id().cast("int").alias("level"), F.floor(seen).alias("pages"), F.count_if(F.col("state") == "pass").alias("passed"),
        (F.floor(F.try_divide(F.sum("overall"), F.count("overall")) * 10 + 0.5) / 10).alias("mean"),
    )
