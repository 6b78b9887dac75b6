"""The audit of a table of pages: elements once, every registered check over them, one score and a ranking a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import access, checks, discovery, messages, scoring, tools
from auditlake.operators.elements import shred
from auditlake.operators.rules import Context, Rule, evaluate

CHECKS: dict[str, Rule] = {r.category: r for r in (discovery.DISCOVERY, checks.STRUCTURE, access.ACCESS, checks.FORMS, checks.ACTIONS, tools.WEBMCP)}


def register_check(rule: Rule, weight: int, step: str, layer: str = "survival") -> None:
    """Add a check with its place in the rubric, or replace one; its facts join the one aggregation over elements, its weight every score."""
    if weight <= 0:
        raise ValueError("a weight above zero")
    CHECKS[rule.category] = rule
    if rule.category not in {r[0] for r in scoring.RUBRIC}:
        scoring.MORE[rule.category] = (weight, step, layer)


def unregister_check(category: str) -> None:
    CHECKS.pop(category)
    scoring.MORE.pop(category, None)


def run_checks(pages: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(page_id, category, applicable, score, confidence, findings, error) of every page and registered check; ``pages`` also has html.

    Pages are read once and never kept: elements flow into one aggregation of all checks' facts.
    """
    return evaluate(Context(pages, shred(pages, kept=False), sidecars), list(CHECKS.values()))


def findings_of(results: DataFrame) -> DataFrame:
    """(page_id, category, ord, id, severity, positive, remediation, evidence, slots): one row a finding, in each check's order."""
    return results.select("page_id", "category", F.posexplode("findings").alias("ord", "f")).select("page_id", "category", "ord", "f.id", "f.severity", "f.positive", "f.remediation", "f.evidence", "f.slots")


def top_finding(results: DataFrame) -> DataFrame:
    """(page_id, top_finding): the id of the weightiest finding to act on."""
    return scoring.top_findings(findings_of(results), 1).select("page_id", F.col("id").alias("top_finding"))


def audit_rows(results: DataFrame) -> DataFrame:
    """One row a page: the score summary and the top finding (null if nothing is to be done)."""
    return scoring.summarize(results).join(top_finding(results), "page_id", "left")


def reports(results: DataFrame, snippets: DataFrame | None = None) -> DataFrame:
    """(page_id, report): a JSON text of each page's score, grade and opportunity, with each check's outcome, summary and findings in order.

    A finding carries title, detail, evidence (paths of elements) and, where something can be done, advice; ``snippets`` (page_id, id,
    snippet) adds markup or script to paste. ``write.text`` or ``write.json`` puts reports into files; categories and findings of a page are
    bounded by the checks.
    """
    f = messages.with_texts(findings_of(results))
    if snippets is not None:
        f = f.join(snippets, ["page_id", "id"], "left")
    else:
        f = f.withColumn("snippet", F.lit(None).cast("string"))
    told = F.struct("ord", "id", "severity", "positive", "title", F.col("detail_text").alias("detail"), "evidence", F.when(F.col("remediation"), F.struct(F.col("advice").alias("text"), "snippet")).alias("remediation"))
    f = f.groupBy("page_id", "category").agg(F.array_sort(F.collect_list(told)).alias("findings"))
    r = results.select("page_id", "category", "applicable", "score", "confidence", F.size(F.filter("findings", lambda x: x["positive"])).alias("good"), "error").join(f, ["page_id", "category"], "left")
    summary = messages.summary_text(F.col("category"), F.col("applicable"), F.col("score"), F.col("good")).alias("summary")
    checked = F.sort_array(F.collect_list(F.struct("category", "applicable", "score", "confidence", summary, "findings", "error"))).alias("categories")
    got = scoring.summarize(results).join(r.groupBy("page_id").agg(checked), "page_id")
    report = F.to_json(F.struct("overall", "grade", "opportunity", "categories"), {"ignoreNullFields": "false"})
    return got.select("page_id", report.alias("report"))


def cards(results: DataFrame) -> DataFrame:
    """What a score card shows: page_id, overall, grade, colour, a lamp for each step, label of the opportunity."""
    s = scoring.summarize(results)
    lamps = scoring.step_states(results).groupBy("page_id").pivot("step", ["find", "understand", "act"]).agg(F.first("state"))
    colour = F.when(F.col("overall").isNull(), "faint").when(F.col("overall") >= 75, "pass").when(F.col("overall") >= 40, "warn").otherwise("fail")
    return s.select("page_id", "overall", "grade", colour.alias("colour")).join(lamps, "page_id").join(scoring.opportunity_labels(s), "page_id")
