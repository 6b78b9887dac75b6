"""Checks as rules: each names its facts, and all rules' facts are one aggregation over the elements of a page.

A rule says what it marks on each element, which aggregates over a page's elements it needs, which elements are evidence, which
columns follow, and how they make a score and findings. ``evaluate`` puts the marks of all rules into one projection,
their facts into one ``groupBy`` over the elements and all outcomes into one projection, so another rule costs columns and no
shuffle. A rule whose outcome is a Python function of one page's facts may fail for a page: that page's result says so, and is
unscored there and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "struct<id:string,severity:string,positive:boolean,remediation:boolean>"
FINDING = f"struct<meta:{META},evidence:array<string>,slots:map<string,string>>"
OUTCOME = f"struct<category:string,applicable:boolean,score:int,confidence:string,findings:array<{FINDING}>,error:string>"
EVIDENCE = 5
MASK_BITS = 62  # kinds of evidence in one long


class Context(NamedTuple):
    """``pages`` (page_id, url, status, headers), ``nodes`` (their elements), ``sidecars`` (see the discovery check)."""

    pages: DataFrame
    nodes: DataFrame
    sidecars: DataFrame | None = None


class Facts:
    """Reads a rule's own columns; counts and flags of pages without elements are 0 and false."""

    def __init__(self, prefix: str, bits: dict[str, tuple[int, int]] | None = None):
        self.prefix, self.bits = prefix, bits or {}

    def __call__(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")

    def n(self, name: str) -> Column:
        return F.expr(f"coalesce({self.prefix}{name}, 0)")

    def yes(self, name: str) -> Column:
        return F.expr(f"coalesce({self.prefix}{name}, false)")

    def paths(self, name: str) -> Column:
        """Paths of the first elements that are evidence of this kind, in document order."""
        bit, most = self.bits[name]
        return F.expr(f"slice(transform(filter(evidence, e -> (e.kinds{bit // MASK_BITS} & {1 << bit % MASK_BITS}L) != 0), e -> e.path), 1, {most})")


class Outcome(NamedTuple):
    applicable: Column
    score: Column
    confidence: Column
    findings: list[Column]


class Rule(NamedTuple):
    """``marks``: columns over the element table by name. ``facts``: aggregates over a page's elements, by marks and the table's columns.
    ``evidence``: conditions on elements by name, with how many to name. ``beside``: rows (page_id, ...) of facts from elsewhere. ``steps``: columns that
    follow, each step's from those before. ``outcome``: the result as columns; or ``judge``: as a function of a dict of the facts to
    (applicable, score, confidence, [(id, severity, positive, remediation)])."""

    category: str
    facts: Callable[[Facts], dict[str, Column]]
    outcome: Callable[[Facts], Outcome] | None = None
    marks: Callable[[], dict[str, Column]] | None = None
    evidence: Callable[[Facts], dict[str, tuple[Column, int]]] | None = None
    steps: tuple[Callable[[Facts], dict[str, Column]], ...] = ()
    beside: Callable[[Context], DataFrame] | None = None
    judge: Callable[[dict], tuple] | None = None


def finding(when: Column, id_: str, severity: str | Column, positive: bool = False, fix: bool | Column | None = None, evidence: Column | None = None, **slots: Column) -> Column:
    """A finding where the condition holds, else null. ``evidence``: paths of elements; ``slots``: what its text names."""
    fixes = (not positive) if fix is None else fix
    if isinstance(severity, Column) or isinstance(fixes, Column):
        meta = F.struct(F.lit(id_).alias("id"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.lit(positive).alias("positive"), (fixes if isinstance(fixes, Column) else F.lit(fixes)).alias("remediation"))
    else:
        meta = F.expr(f"named_struct('id', '{id_}', 'severity', '{severity}', 'positive', {positive}, 'remediation', {fixes})")
    paths = F.expr("cast(array() AS array<string>)") if evidence is None else evidence
    named = F.create_map(*[x for k, v in slots.items() for x in (F.lit(k), v.cast("string"))]) if slots else F.expr("cast(map() AS map<string,string>)")
    return F.when(when, F.struct(meta.alias("meta"), paths.alias("evidence"), named.alias("slots")))


def points(n: int, when: Column) -> Column:
    return F.when(when, n).otherwise(0)


def has(when: Column) -> Column:
    """Whether any row meets the condition; null counts as not."""
    return F.coalesce(F.bool_or(when), F.lit(False))


def first_of(when: Column, value: Column) -> Column:
    """The value of the first element, in document order, that meets the condition."""
    return F.min(F.when(when, F.struct(F.col("pre"), value.alias("v"))))["v"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


class Compiled(NamedTuple):
    marks: list[Column]
    facts: list[Column]
    evidence: list[tuple[Column, int]]
    steps: list[list[Column]]
    outcome: Column | None


@lru_cache(maxsize=256)
def compiled(session: str, rule: Rule, n: int, first_bit: int) -> Compiled:
    """A rule's columns with its place among all rules in their names; made once a session, as making them takes longer than small tables do."""
    prefix = f"r{n}_"
    named = lambda columns, p=prefix: [c.alias(p + name) for name, c in columns.items()]
    marks = Facts(f"{prefix}m_")
    evidence = rule.evidence(marks) if rule.evidence else {}
    f = Facts(prefix, {name: (first_bit + i, most) for i, (name, (_, most)) in enumerate(evidence.items())})
    outcome = None
    if rule.outcome is not None:
        o = rule.outcome(f)
        found = F.filter(F.array(*o.findings), lambda x: x.isNotNull())
        outcome = F.struct(F.lit(rule.category), o.applicable.cast("boolean"), o.score.cast("int"), o.confidence, found, F.lit(None).cast("string")).cast(OUTCOME)
    return Compiled(named(rule.marks() if rule.marks else {}, marks.prefix), named(rule.facts(marks)), list(evidence.values()), [named(step(f)) for step in rule.steps], outcome)


def plan(context: Context, rules: list[Rule]) -> list[Compiled]:
    session, bit, out = context.pages.sparkSession.sparkContext.applicationId, 0, []
    for n, rule in enumerate(rules):
        out.append(compiled(session, rule, n, bit))
        bit += len(out[-1].evidence)
    return out


def page_facts(nodes: DataFrame, made: list[Compiled]) -> DataFrame:
    """One row a page with the facts of all rules and its evidence, by one aggregation."""
    marked = nodes.select("*", *[c for x in made for c in x.marks])
    kinds = [when for x in made for when, _ in x.evidence]
    masks = []
    for i in range(0, max(len(kinds), 1), MASK_BITS):
        bits = [F.when(when, F.expr(f"{1 << j}L")).otherwise(F.expr("0L")) for j, when in enumerate(kinds[i : i + MASK_BITS])]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), bits, F.expr("0L")).alias(f"kinds{i // MASK_BITS}"))
    marked = marked.select("*", *masks)
    some = any_of([F.col(f"kinds{i}") != 0 for i in range(len(masks))])
    told = F.array_sort(F.collect_list(F.when(some, F.struct("pre", "path", *[f"kinds{i}" for i in range(len(masks))])))).alias("evidence")
    return marked.groupBy("page_id").agg(*[c for x in made for c in x.facts], told)


def judged(rule: Rule) -> Callable[[Column], Column]:
    """A rule's Python function over a struct of its facts, each page on its own."""
    judge, category = rule.judge, rule.category

    @F.pandas_udf(T._parse_datatype_string(OUTCOME))
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            try:
                applicable, score, confidence, found = judge(row)
                findings = [{"meta": {"id": i, "severity": s, "positive": p, "remediation": r}, "evidence": [], "slots": {}} for i, s, p, r in found]
                out.append((category, bool(applicable), None if score is None else int(score), str(confidence), findings, None))
            except Exception as e:  # noqa: BLE001  whatever a check does, other pages and checks go on
                out.append((category, True, None, "low", [], f"{type(e).__name__}: {e}"[:300]))
        frame = pd.DataFrame(out, columns=["category", "applicable", "score", "confidence", "findings", "error"])
        return frame.astype({"score": "Int32"})

    return run


def evaluate(context: Context, rules: list[Rule]) -> DataFrame:
    """(page_id, category, applicable, score, confidence, findings, error) of every page and rule; a finding has id, severity,
    positive, remediation, evidence and slots.

    Elements are shuffled once, as one row of facts a page; a rule's ``beside`` brings shuffles of its own.
    """
    made = plan(context, rules)
    p = context.pages.select(*[c for c in context.pages.columns if c != "html"])
    p = p.join(page_facts(context.nodes, made), "page_id", "left")
    for n, rule in enumerate(rules):
        if rule.beside is not None:
            more = rule.beside(context)
            p = p.join(more.select("page_id", *[F.col(c).alias(f"r{n}_{c}") for c in more.columns if c != "page_id"]), "page_id", "left")
    for step in range(max(len(x.steps) for x in made)):
        p = p.select("*", *[c for x in made if step < len(x.steps) for c in x.steps[step]])
    outcomes = []
    for n, (rule, x) in enumerate(zip(rules, made)):
        if rule.judge is not None:
            own = [F.col(c).alias(c.removeprefix(f"r{n}_")) for c in p.columns if c.startswith(f"r{n}_")]
            outcomes.append(judged(rule)(F.struct(*(own or [F.lit(None).cast("int").alias("nothing")]))))
        else:
            outcomes.append(x.outcome)
    flat = "transform(findings, f -> named_struct('id', f.meta.id, 'severity', f.meta.severity, 'positive', f.meta.positive, 'remediation', f.meta.remediation, 'evidence', f.evidence, 'slots', f.slots)) AS findings"
    return p.select("page_id", F.inline(F.array(*outcomes))).selectExpr("page_id", "category", "applicable", "score", "confidence", flat, "error")


def alone(context: Context, rule: Rule) -> DataFrame:
    """One rule's rows (page_id, applicable, score, confidence, findings)."""
    return evaluate(context, [rule]).select("page_id", "applicable", "score", "confidence", "findings")
