"""Every query against its SQL on the smallest tables, and cases that the tables lack."""

from collections import deque
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from auditlake.operators import limiter, robots, scoring
from auditlake.plans import audits, catalog, pages  # noqa: F401

DATA = Path("/root/testdata/sf0.001")


def rows(frame):
    return sorted(repr([None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in frame)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(got.columns)
    want = con.sql(catalog.SQL[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert rows(got.select(*cols).collect()) == rows([[r[i] for i in order] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() == 50


def test_worked_scores(spark):
    ids = [r[0] for r in scoring.RUBRIC]
    five = [(1, c, True, 0 if c == "webmcp-capability" else 60) for c in ids]
    rest = [(2, c, c != "form-semantics", None if c == "form-semantics" else 0 if c == "webmcp-capability" else 100) for c in ids]
    df = spark.createDataFrame(five + rest, "page_id long, category string, applicable boolean, score int")
    got = {r.page_id: r for r in scoring.summarize(df).collect()}
    assert (got[1].overall, got[1].survival, got[1].opportunity) == (51, 60, 66)
    assert (got[2].overall, got[2].coverage) == (82, 1.0)


def test_missing_category_applies_unscored(spark):
    df = spark.createDataFrame([(1, "actionability", True, 80)], "page_id long, category string, applicable boolean, score int")
    r = scoring.summarize(df).first()
    assert (r.overall, r.coverage, r.superpower) == (80, 0.15, None)


def test_negative_limit_gives_nothing(spark):
    df = spark.createDataFrame([(1, "actionability", 0, "a", "high", False)], "page_id long, category string, ord int, id string, severity string, positive boolean")
    assert scoring.top_findings(df, -1).count() == 0 and scoring.top_findings(df, 2).count() == 1


def test_limiter_forgets_exactly_at_the_window_and_never_counts_rejects():
    hits = deque()
    assert [limiter.decide(hits, t * 1_000_000, 60_000_000, 2) for t in (0, 1, 2, 60, 60, 61)] == [0, 0, 58, 0, 1, 0]


def test_keyless_line_keeps_an_agent_run(spark):
    body = "User-agent: a\nnoise\nUser-agent: b\nDisallow: /x"
    parsed = robots.parse_robots(spark.createDataFrame([("s", body)], "site string, body string"))
    asked = spark.createDataFrame([("s", "a", "/x"), ("s", "b", "/x"), ("s", "c", "/x")], "site string, token string, path string")
    assert {r.token: r.allowed for r in robots.robots_allowed(parsed, asked).collect()} == {"a": False, "b": False, "c": True}
