"""Rules as one pass: exchanges, registered and failing checks, evidence and texts, markup to paste, and the robots index."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.operators import access, audit, discovery, messages, robots, scoring, tools
from auditlake.operators.elements import shred
from auditlake.operators.rules import Context, Outcome, Rule, evaluate, finding, has
from auditlake.plans.pages import plain
from auditlake.sources.cuts import cut

SEVERITIES = {"critical", "high", "medium", "low", "info"}


def pages(spark, *html, status=200):
    rows = [(i, "https://n.example/p", h, status, {}) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status int, headers map<string,string>")


def nothing(spark):
    return spark.createDataFrame([], "page_id long, key string, path string, ord int, observed boolean, status int, body string")


def test_elements_are_shuffled_once(spark):
    p = pages(spark, "<h1>a</h1>", None)
    rules = [r._replace(beside=None) for r in audit.CHECKS.values() if r.beside is None]
    assert len(rules) == 5
    out = evaluate(Context(p, shred(p, kept=False)), rules)
    shown = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    final = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bMapInArrow\b", final)) == 1 and len(re.findall(r"\bExchange hashpartitioning", final)) == 2, shown  # facts, and pages to join
    whole = audit.run_checks(p, nothing(spark))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bMapInArrow\b", whole)) == 1


def test_lists_of_other_parents_and_marker_in_markup(spark):
    items = "<li>x</li>" * 25
    bare = "<html><head><script src=a.js></script></head><body data-k='__NEXT_DATA__'><a href='/x'>x</a></body></html>"
    p = pages(spark, f"<div>{items}</div>", f"<menu>{items}</menu>", f"<ol>{items}</ol>", bare, bare.replace("__NEXT_DATA__", "__next_data__"))
    got = {r.page_id: r for r in plain(access.check_access(p, shred(p))).collect()}
    assert ["no-pagination" in got[i].ids for i in range(3)] == [False, False, True]
    assert "access.js.likely" in got[3].ids and got[3].score == 60 and "access.js.possible" in got[4].ids and got[4].score == 90


def test_a_registered_check_counts_and_a_failing_one_stays_alone(spark):
    p, s = pages(spark, "<h1>a</h1><a href='/x'>Buy</a>", "<b>b</b>", ""), nothing(spark)
    before = {r.page_id: r.overall for r in scoring.summarize(audit.run_checks(p, s)).collect()}

    def judge(facts):
        if facts["bold"]:
            raise RuntimeError("no bold")
        return True, 0, "high", [("own.none", "low", False, True)]

    def columns(f):
        return Outcome(F.lit(True), F.when(f.yes("bold"), 100).otherwise(0), F.lit("high"), [finding(f.yes("bold"), "own.bold", "info", True)])

    facts = lambda m: {"bold": has(F.col("tag") == "b")}
    try:
        audit.register_check(Rule("own", facts, judge=judge), 50, "find")
        audit.register_check(Rule("columns", facts, columns), 50, "find")
        results = cut(audit.run_checks(p, s))
        own = {r.page_id: r for r in results.where("category = 'own'").collect()}
        assert (own[0].score, own[0].confidence, own[0].error, own[0].findings[0].id) == (0, "high", None, "own.none")
        assert (own[1].score, own[1].confidence, own[1].error) == (None, "low", "RuntimeError: no bold") and own[2].score == 0
        assert {r.page_id: r.score for r in results.where("category = 'columns'").collect()} == {0: 0, 1: 100, 2: 0}
        after = {r.page_id: r.overall for r in scoring.summarize(results).collect()}
        assert after[0] < before[0] and after[1] > before[1] and results.count() == 24
        assert {r.step for r in scoring.step_states(results).collect()} == {"find", "understand", "act"}
    finally:
        audit.unregister_check("own")
        audit.unregister_check("columns")
    assert {r.page_id: r.overall for r in scoring.summarize(audit.run_checks(p, s)).collect()} == before
    with pytest.raises(ValueError):
        audit.register_check(Rule("none", facts, columns), 0, "find")


def test_every_finding_has_its_texts():
    ids = [m.id for m in messages.MESSAGES]
    assert len(ids) == len(set(ids)) == 73 and all(m.title and m.detail for m in messages.MESSAGES)
    assert set(messages.SUMMARIES) == {r[0] for r in scoring.RUBRIC}


def test_reports_tell_what_was_found_where(spark):
    page = "<main><h1>Shop</h1><form id=f>" + "<input placeholder='Your {n} email'>" * 7 + "<input name=email></form><div onclick='x()'>Buy now</div></main>"
    p = pages(spark, page, None)
    results = cut(audit.run_checks(p, nothing(spark)))
    found = messages.with_texts(audit.findings_of(results))
    for r in found.collect():
        assert r.severity in SEVERITIES and r.title != r.id and "{" not in r.detail_text.replace("{n}", "") and (r.advice is not None) == r.remediation
    snippets = tools.tool_stubs(p, shred(p)).select("page_id", F.lit("webmcp.stub.imperative").alias("id"), F.col("call").alias("snippet"))
    report = {r.page_id: json.loads(r.report) for r in audit.reports(results, snippets).collect()}
    forms = next(c for c in report[0]["categories"] if c["category"] == "form-semantics")
    missing = next(f for f in forms["findings"] if f["id"] == "forms.label.missing")
    assert missing["detail"] == "8 of 8 controls have no accessible name." and missing["remediation"]["text"]
    assert missing["evidence"] == [f"main > form#f > input:nth-of-type({i})" for i in range(1, 6)] or missing["evidence"][0] == "form#f > input:nth-of-type(1)"
    assert len(missing["evidence"]) == 5
    placeholder = next(f for f in forms["findings"] if f["id"] == "forms.label.placeholder-only")
    assert placeholder["detail"].startswith("7 controls") and forms["summary"] == messages.SUMMARIES["form-semantics"][2]
    stub = next(f for c in report[0]["categories"] for f in c["findings"] if f["id"] == "webmcp.stub.imperative")
    assert "registerTool" in stub["remediation"]["snippet"]
    assert next(c for c in report[1]["categories"] if c["category"] == "form-semantics")["summary"] == "No form to fill in."


def test_slots_are_filled_once(spark):
    df = spark.createDataFrame([("a {x} b {y}{z}", {"x": "{y}", "y": "2"})], "t string, s map<string,string>")
    assert df.select(messages.filled_in(F.col("t"), F.col("s")).alias("o")).first().o == "a {y} b 2"


def test_tool_names_labels_and_corrected_markup(spark):
    page = """<h2>Eat</h2><form toolname="bad name" data-x='a"b' onsubmit=""><label for="e"></label><label for="e">Second</label><label>Wrap<input id="e" name="x"></label>
    <input name="n&quot;&lt;"><select id="My Id"><option>1</select><input name="ok" toolparamdescription="told"></form><form><legend>L</legend><input type="search" name="s"><button>Reserve a table</button></form>"""
    nodes = shred(pages(spark, page))
    tags = [r.markup for r in tools.corrected_tags(nodes).collect()]
    assert tags == ['<form data-x="a&quot;b" onsubmit toolname="bad_name" tooldescription="Eat">']
    lines = [r.markup for r in tools.control_lines(nodes).orderBy("pre").collect()]
    assert lines[0] == '<input id="e" name="x" type="text" toolparamdescription="Wrap">' and lines[2] == '<select id="My Id" name="my_id" toolparamdescription="my_id">…</select>'
    assert lines[1] == '<input name="n&quot;&lt;" type="text" toolparamdescription="n&quot;&lt;">' and lines[3] == '<input name="s" type="search" toolparamdescription="s">'
    only = pages(spark, "<form><legend> Your  table </legend><input name=a><button>Reserve a table</button></form>")
    r = tools.tool_stubs(only, shred(only)).first()
    assert (r.tool_name, r.description) == ("reserve_a_table", "Your table") and r.form_markup.startswith('<form toolname="reserve_a_table"')


def allowed_by_hand(rules, path):
    best = (-1, True)
    for allow, pattern in rules:
        ended = pattern.endswith("$")
        regex = ".*".join(re.escape(x) for x in (pattern[:-1] if ended else pattern).split("*"))
        if pattern and re.match(regex + ("$" if ended else ""), path, re.S):
            best = max(best, (len(pattern), allow))
    return best[1]


def test_robots_index_against_all_rules(spark):
    rng = random.Random(6)
    part = lambda: "/" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 3)))
    sites, bodies, asked = {}, [], []
    for site in range(8):
        rules = [(rng.random() < 0.4, "".join(part() + rng.choice(["", "", "*"]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "$"])) for _ in range(60)] + [(False, "*.pdf$"), (True, "")]
        own = [(False, "/"), (True, "/a")]
        sites[site] = rules, own
        lines = ["User-agent: *", *[f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules], "User-agent: Own/2", *[f"{'Allow' if a else 'Disallow'}: {p}" for a, p in own]]
        bodies.append((site, "\n".join(lines)))
        asked += [(site, t, p) for t in ("own", "other") for p in {"".join(part() for _ in range(rng.randrange(0, 5))) + rng.choice(["", ".pdf"]) for _ in range(40)}]
    parsed = robots.parse_robots(spark.createDataFrame(bodies, "site long, body string"))
    got = {(r.site, r.token, r.path): r.allowed for r in robots.robots_allowed(parsed, spark.createDataFrame([*asked, (99, "own", "/x")], "site long, token string, path string")).collect()}
    assert got.pop((99, "own", "/x")) and len(got) == len(set(asked))
    for (site, token, path), allowed in got.items():
        assert allowed == allowed_by_hand(sites[site][token == "own"], path), (site, token, path)


def test_large_robots_text_makes_few_rows_a_path(spark):
    body = "User-agent: *\n" + "\n".join(f"Disallow: /d{i}/{'x' * (i % 5)}" for i in range(5000)) + "\nAllow: /d7/xx/*ok$"
    parsed = cut(robots.parse_robots(spark.createDataFrame([("s", body)], "site string, body string")))
    sites, rules = robots.indexed(parsed)
    assert len(sites.first().lengths) < 14 and rules.count() == 5001
    paths = spark.range(10_000).select(F.lit("s").alias("site"), F.lit("Bot").alias("token"), F.concat(F.lit("/d"), F.col("id").cast("string"), F.lit("/xxxx/ok")).alias("path"))
    got = robots.robots_allowed(parsed, paths)
    # d0 to d4999, with up to four x; none for the rest
    assert got.where("not allowed").count() == 5000 and got.where("allowed").count() == 5000
    assert robots.robots_allowed(parsed, spark.createDataFrame([("s", "b", "/d7/xx/1ok"), ("s", "b", "/d7/xx/1ok2")], "site string, token string, path string")).orderBy("path").select("allowed").collect() == [(True,), (False,)]


def test_well_known_files_of_one_kind(spark):
    rows = [(0, "well-known", "/.well-known/mcp.json", 4, True, 200, "[]"), (0, "well-known", "/.well-known/mcp/server-card.json", 5, True, 200, '{"name":"n"}'), (1, "well-known", "/.well-known/ai-plugin.json", 6, True, 200, "<html>")]
    side = spark.createDataFrame(rows, nothing(spark).schema)
    p = pages(spark, "", "")
    ids = {r.page_id: r.ids for r in plain(discovery.check_discovery(p, shred(p), side)).collect()}
    assert "discovery.mcp.invalid" in ids[0] and "discovery.mcp.missing" in ids[1]


def test_written_controls_read_back_as_meant(spark):
    from auditlake.functions.html import elements
    from auditlake.operators import snippets

    page = '<form><input name="e-mail" required><input id="phone" placeholder="&quot;&gt;<script>"><select name="x"><option>1</select><select name="nothing"></select><textarea aria-label="N &amp; M">a\n b</textarea><input autocomplete="NAME"></form>'
    nodes = shred(pages(spark, page, "<p>none"))
    found = snippets.form_snippets(nodes).orderBy("pre").collect()
    back = [[e for e in elements(r.markup) if e.tag in ("label", "input", "select", "textarea", "option")] for r in found]
    assert [[e.tag for e in b] for b in back] == [["label", "input"], ["label", "input"], ["label", "select", "option"], ["label", "select"], ["label", "textarea"], ["label", "input"]]
    assert all(b[0].attrs["for"] == b[1].attrs["id"] for b in back)
    assert (back[0][1].attrs["type"], back[0][1].attrs["autocomplete"], "required" in back[0][1].attrs) == ("email", "email", True)
    assert (back[1][1].attrs["type"], back[1][0].text) == ("tel", '"><script>') and back[4][1].text == "a b" and back[4][0].text == "N & M" and back[5][1].attrs["autocomplete"] == "name"
    every = snippets.audit_snippets(pages(spark, page, "<p>none"), nodes)
    ids = {(r.page_id, r.id) for r in every.collect()}
    assert every.count() == len(ids) and (0, "forms.label.missing") in ids and (0, "webmcp.none") in ids and (1, "webmcp.stub.imperative") in ids and (1, "forms.label.missing") not in ids
    report = json.loads(audit.reports(audit.run_checks(pages(spark, page, "<p>none"), nothing(spark)), every).where("page_id = 0").first().report)
    label = next(f for c in report["categories"] for f in c["findings"] if f["id"] == "forms.label.missing")
    assert label["remediation"]["snippet"].startswith("<label for=")


def test_views_and_table_function(spark):
    from auditlake.sources.tables import register_views

    register_views(spark, pages(spark, "<h1>a</h1><form><input></form>", None, ""), nothing(spark))
    assert spark.sql("SELECT count(*) FROM page_elements(TABLE(SELECT page_id, html, 1 AS page FROM VALUES (1L, '<p>a<p>b'), (2L, NULL) AS t(page_id, html)))").first()[0] == 5
    rows = spark.sql("SELECT s.overall, f.severity, n.tag FROM scores s JOIN findings f USING (page_id) JOIN nodes n ON n.page_id = f.page_id AND n.path = f.evidence[0] WHERE f.id = 'forms.label.missing'").collect()
    assert [(r.severity, r.tag) for r in rows] == [("high", "input")] and spark.sql("SELECT count(*) FROM results").first()[0] == 18
    for view in ("nodes", "results", "findings", "scores"):
        spark.catalog.dropTempView(view)
