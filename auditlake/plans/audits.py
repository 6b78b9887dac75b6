"""Whole audits: pages with made-up statuses, headers and sidecars, each by one rule of the page's id in both engines.

The pages lack forms, tools, challenges and long lists; SITE adds them. Nothing here was recorded from a live site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import net, text
from auditlake.operators import access, audit, discovery, gates, redirects, scoring, tools
from auditlake.operators.elements import shred
from auditlake.plans.catalog import RUBRIC_SQL, query, table
from auditlake.plans.pages import plain
from auditlake.sources.cuts import cut

SHELL = '<html><head><script src="/a.js"></script></head><body><div id="root"></div><noscript>Please enable JavaScript</noscript></body></html>'
ITEMS = "<ul>" + "<li>x</li>" * 25 + "</ul>"
TOOL = '<form toolname="book_table" tooldescription="Books a table"><input name="n" toolparamdescription="Name" required></form><script>document.modelContext.registerTool({inputSchema:{}})</script><link rel="service-desc" href="/api/openapi.json">'
HALF = '<form toolname="bad name" tooldescription="x"><input required></form><script>navigator.modelContext.registerTool({})</script><link rel="alternate" type="application/rss+xml" href="feed.xml"><a href="/docs/../swagger.json">API</a>'
#: The same text in Spark's and DuckDB's SQL.
SITE = f"""CASE page_id % 8 WHEN 1 THEN replace(html, '</article>', '<form><div class="g-recaptcha"></div><input name="a"></form></article>')
WHEN 2 THEN replace(html, '</article>', '<script src="https://www.google.com/recaptcha/api.js"></script></article>') WHEN 3 THEN '{SHELL}'
WHEN 4 THEN replace(html, '</article>', '{ITEMS}</article>') WHEN 5 THEN replace(html, '</article>', '{ITEMS}<a href="?page=2">n</a></article>')
WHEN 6 THEN replace(html, '</article>', '{TOOL}</article>') WHEN 7 THEN replace(html, '</article>', '{HALF}</article>') ELSE html END"""
HEADERS = {
    "x-robots-tag": "CASE page_id % 6 WHEN 1 THEN 'noai' WHEN 2 THEN 'noindex, nofollow' END", "cf-mitigated": "CASE WHEN page_id % 6 = 3 THEN 'challenge' END",
    "permissions-policy": "CASE page_id % 11 WHEN 5 THEN 'camera=(), tools=()' WHEN 6 THEN 'tools=(self)' END", "origin-agent-cluster": "CASE WHEN page_id % 13 = 7 THEN '?0' END",
    "origin-trial": "CASE WHEN page_id % 17 = 3 THEN 'token' END",
}
STATUS = "CASE WHEN page_id % 9 = 4 THEN 404 ELSE 200 END"
ROBOTS = ["User-agent: *\nDisallow: /", "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nSitemap: https://x.example/s.xml", "User-agent: *\nDisallow:"]


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, status, headers)"""
    headers = F.create_map(*[x for name, sql in HEADERS.items() for x in (F.lit(name), F.expr(sql))])
    kept = F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(SITE).alias("html"), F.expr(STATUS).alias("status"), kept)


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, key, path, ord, observed, status, body): robots by id % 5, sitemap by % 3, llms by % 4, well-known files by % 7."""
    n = F.col("page_id")
    kind = "struct<observed:boolean,status:int,body:string>"
    came = lambda body, status=200: F.struct(F.lit(True), F.lit(status), F.lit(body)).cast(kind)
    absent, unseen = came("<html>", 404), F.struct(F.lit(False), F.lit(None), F.lit(None)).cast(kind)
    rule = {
        "/robots.txt": F.when(n % 5 == 0, unseen).when(n % 5 == 2, came(ROBOTS[0])).when(n % 5 == 3, came(ROBOTS[1])).when(n % 5 == 4, came(ROBOTS[2])),
        "/sitemap.xml": F.when(n % 3 == 0, came("<?xml?><URLSET/>")).when(n % 3 == 2, unseen),
        "/llms.txt": F.when(n % 4 == 0, came("# T\n> x")).when(n % 4 == 1, came("no title")).when(n % 4 == 3, unseen),
        "/.well-known/oauth-protected-resource": F.when(n % 7 == 0, came('{"resource":"r","authorization_servers":[]}')).when(n % 7 == 1, came('{"resource":1}')),
        "/.well-known/ai-plugin.json": F.when(n % 7 == 2, came('{"a":1}')),
    }
    rows = []
    for i, (key, path) in enumerate(discovery.TARGETS):
        got = F.coalesce(rule[path], absent) if path in rule else absent
        got = F.when(n % 7 == 6, unseen).otherwise(got) if key == "well-known" else got
        rows.append(F.struct(F.lit(key).alias("key"), F.lit(path).alias("path"), F.lit(i).alias("ord"), got.alias("got")))
    return table(spark, sf_dir, "pages").select("page_id", F.inline(F.array(*rows))).select("page_id", "key", "path", "ord", "got.*")


TEXT_SQL = "regexp_replace(regexp_replace(html, '<head[ >].*?</head>|<(script|style|noscript)[ >].*?</(script|style|noscript)>', ' ', 'gs'), '<[^>]*>', '', 'g')"
S_SQL = f"""p AS (SELECT page_id, url, page_id % 8 AS k, {SITE} AS html, {STATUS} AS status, {', '.join(f'{sql} AS "{name}"' for name, sql in HEADERS.items())} FROM pages),
b AS (SELECT *, len(regexp_extract_all({TEXT_SQL}, '\\S+')) AS words, coalesce(list_max(list_transform(regexp_extract_all(html, '<[uo]l[^>]*>.*?</[uo]l>', 0, 's'), lambda x: len(regexp_extract_all(x, '<li[ >]')))), 0) AS li,
  len(regexp_extract_all(html, '<article[ >]')) AS articles, html LIKE '%<script src=%' AS scripted, regexp_matches(html, '<a [^>]*href=|<form') AS links FROM p)"""
ACCESS_SQL = f"""{S_SQL}, x AS (SELECT *, coalesce("x-robots-tag" = 'noai', false) AS noai, coalesce("x-robots-tag" LIKE 'noindex%', false) AS noindex, "cf-mitigated" IS NOT NULL AS bots,
  html LIKE '%recaptcha%' AS challenge, html LIKE '%class="g-recaptcha"%' AS on_form,
  CAST(words < 50 AND scripted AS INT) + CAST(html LIKE '%<div id="root"></div>%' AS INT) + CAST(html LIKE '%enable JavaScript%' AS INT) + CAST(NOT links AS INT) AS js,
  (li >= 20 OR articles >= 20) AND NOT regexp_matches(html, '<a [^>]*href="[^"]*page=|(class|id)="[^"]*(pagination|pager)') AS unpaged FROM b),
y AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 10 ELSE 0 END + CASE WHEN noai OR noindex THEN 0 ELSE 10 END + CASE WHEN bots THEN 0 ELSE 10 END
  + CASE WHEN NOT challenge THEN 20 WHEN on_form THEN 0 ELSE 10 END + CASE js WHEN 0 THEN 35 WHEN 1 THEN 25 WHEN 2 THEN 12 ELSE 0 END + CASE WHEN unpaged THEN 0 ELSE 15 END AS total FROM x),
access AS (SELECT *, CAST(CASE WHEN js >= 3 THEN least(total, 35) WHEN js = 2 THEN least(total, 60) ELSE total END AS INT) AS score FROM y)"""


@query(f"""WITH {ACCESS_SQL} SELECT page_id, true AS applicable, score, CASE WHEN js >= 2 THEN 'low' WHEN js = 1 OR bots THEN 'medium' ELSE 'high' END AS confidence,
concat_ws(',', CASE WHEN NOT challenge THEN 'access.captcha.none' WHEN on_form THEN 'access.captcha.on-form' ELSE 'access.captcha.present' END,
CASE WHEN bots THEN 'access.headers.bot-management' END, CASE WHEN noai THEN 'access.headers.noai' WHEN noindex THEN 'access.headers.noindex' WHEN NOT bots THEN 'access.headers.ok' END,
CASE js WHEN 0 THEN 'access.js.static' WHEN 1 THEN 'access.js.possible' WHEN 2 THEN 'access.js.likely' ELSE 'access.js.required' END, CASE WHEN unpaged THEN 'access.scroll.no-pagination' END) AS ids FROM access""")
def check_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site(spark, sf_dir)
    return plain(access.check_access(pages, shred(pages, kept=False)))


WEBMCP_SQL = f"""{S_SQL}, w AS (SELECT *, coalesce("permissions-policy" LIKE '%tools=()%', false) AS off, coalesce("origin-agent-cluster" = '?0', false) AS alone, "origin-trial" IS NOT NULL AS trial,
  html LIKE '%toolname="book_table"%' AS valid, html LIKE '%toolname="bad name"%' AS broken FROM b),
tools AS (SELECT *, CAST(CASE WHEN off THEN 0 WHEN alone THEN least(20, t) ELSE t END AS INT) AS score FROM (SELECT *, CASE WHEN valid THEN 90 WHEN broken THEN 45 ELSE 0 END + CASE WHEN trial THEN 5 ELSE 0 END AS t FROM w))"""


@query(f"""WITH {WEBMCP_SQL} SELECT page_id, true AS applicable, score, CASE WHEN valid OR off THEN 'high' ELSE 'medium' END AS confidence,
concat_ws(',', CASE WHEN broken THEN 'webmcp.declarative.incomplete' WHEN valid THEN 'webmcp.declarative.present' END, CASE WHEN broken THEN 'webmcp.imperative.legacy' END,
CASE WHEN broken OR valid THEN 'webmcp.imperative.referenced' END, CASE WHEN NOT broken AND NOT valid AND NOT off THEN 'webmcp.none' END, CASE WHEN alone THEN 'webmcp.origin-cluster.off' END,
CASE WHEN trial THEN 'webmcp.origin-trial.present' END, CASE WHEN off THEN 'webmcp.policy.disabled' END, CASE WHEN NOT broken AND NOT valid AND NOT off THEN 'webmcp.stub.imperative' END) AS ids FROM tools""")
def check_webmcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site(spark, sf_dir)
    return plain(tools.check_webmcp(pages, shred(pages, kept=False)))


DISCOVERY_SQL = f"""{S_SQL}, d AS (SELECT *, page_id % 5 AS r, page_id % 3 AS s, page_id % 4 AS l, page_id % 7 AS w, html LIKE '%service-desc%' OR html LIKE '%swagger.%' AS api FROM b),
e AS (SELECT *, CASE r WHEN 1 THEN 15 WHEN 3 THEN 25 WHEN 4 THEN 25 ELSE 0 END + CASE WHEN s = 0 OR r = 3 THEN 25 ELSE 0 END + CASE l WHEN 0 THEN 15 WHEN 1 THEN 10 ELSE 0 END + CASE WHEN api THEN 15 ELSE 0 END
  + CASE w WHEN 0 THEN 20 WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 0 END AS got, CASE WHEN r = 0 THEN 0 ELSE 25 END + CASE WHEN s = 2 AND r <> 3 THEN 0 ELSE 25 END + CASE WHEN l = 3 THEN 0 ELSE 15 END + 15 + CASE WHEN w = 6 THEN 0 ELSE 20 END AS most FROM d),
disc AS (SELECT *, CAST(floor(100.0 * got / most + 0.5) AS INT) AS score FROM e)"""


@query(f"""WITH {DISCOVERY_SQL} SELECT page_id, true AS applicable, score, CASE WHEN most = 100 THEN 'high' WHEN most >= 60 THEN 'medium' ELSE 'low' END AS confidence,
concat_ws(',', CASE WHEN l IN (0, 1) THEN 'discovery.llms.present' WHEN l = 2 THEN 'discovery.llms.missing' END, CASE WHEN NOT api THEN 'discovery.machine-entry.missing' END,
CASE w WHEN 0 THEN 'discovery.mcp.present' WHEN 1 THEN 'discovery.mcp.invalid' WHEN 2 THEN NULL WHEN 6 THEN NULL ELSE 'discovery.mcp.missing' END, CASE WHEN api THEN 'discovery.openapi.present' END,
CASE r WHEN 1 THEN 'discovery.robots.missing' WHEN 2 THEN 'discovery.robots.blocks-all' WHEN 3 THEN 'discovery.robots.blocks-ai-agents' WHEN 4 THEN 'discovery.robots.present' END,
CASE WHEN s = 0 OR r = 3 THEN 'discovery.sitemap.present' WHEN s = 1 THEN 'discovery.sitemap.missing' END, CASE WHEN most < 100 THEN 'discovery.unobserved' END, CASE WHEN w = 2 THEN 'discovery.wellknown.other' END) AS ids FROM disc""")
def check_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site(spark, sf_dir)
    return plain(discovery.check_discovery(pages, shred(pages, kept=False), sidecars(spark, sf_dir)))


AUDIT_SQL = f"""{ACCESS_SQL}, {WEBMCP_SQL.removeprefix(S_SQL + ", ")}, {DISCOVERY_SQL.removeprefix(S_SQL + ", ")},
h AS (SELECT page_id, html, k, list_transform(regexp_extract_all(html, '<h([1-6])[ >]', 1), lambda x: CAST(x AS INT)) AS n FROM b),
h2 AS (SELECT *, len(list_filter(n, lambda x: x = 1)) AS h1s, len(list_filter(range(2, len(n) + 1), lambda i: n[i] > n[i - 1] + 1)) AS skips FROM h),
structure AS (SELECT page_id, CAST(CASE WHEN regexp_matches(html, '<title>[^<]*\\S[^<]*</title>') THEN 5 ELSE 0 END + CASE WHEN html LIKE '%<main%' THEN 10 ELSE 0 END + CASE WHEN html LIKE '%<nav%' THEN 5 ELSE 0 END
  + CASE WHEN html LIKE '%<footer%' OR html LIKE '%<header%' THEN 5 ELSE 0 END + CASE WHEN h1s = 1 THEN 10 WHEN h1s > 1 THEN 5 ELSE 0 END + CASE WHEN len(n) = 0 THEN 0 WHEN skips = 0 THEN 10 ELSE 5 END
  + CASE WHEN regexp_matches(html, '<html[^>]* lang="[^"]') THEN 5 ELSE 0 END AS INT) AS score FROM h2),
forms AS (SELECT page_id, CASE k WHEN 1 THEN 50 WHEN 6 THEN 50 WHEN 7 THEN 35 END AS score FROM b),
acts AS (SELECT page_id, CASE WHEN len(regexp_extract_all(html, '<a [^>]*href="[^"#]')) + CAST(k IN (1, 6, 7) AS INT) > 0 THEN 100 END AS score FROM b),
rubric(ord, category, weight, step, layer) AS ({RUBRIC_SQL}),
r AS (SELECT page_id, 0 AS ord, true AS applicable, score FROM disc UNION ALL SELECT page_id, 1, true, score FROM structure UNION ALL SELECT page_id, 2, true, score FROM access
  UNION ALL SELECT page_id, 3, score IS NOT NULL, score FROM forms UNION ALL SELECT page_id, 4, score IS NOT NULL, score FROM acts UNION ALL SELECT page_id, 5, true, score FROM tools),
c AS (SELECT * FROM r JOIN rubric USING (ord)), k AS (SELECT *, applicable AND score IS NOT NULL AS known FROM c)"""
AUDIT_SUMMARY_SQL = f"""{AUDIT_SQL}, s1 AS (SELECT page_id, CAST(floor(sum(weight * score) FILTER (known) * 1.0 / sum(weight) FILTER (known) + 0.5) AS INT) AS overall,
  floor(sum(weight) FILTER (known) * 1.0 / sum(weight) FILTER (applicable) * 100 + 0.5) / 100 AS coverage,
  CAST(floor(sum(weight * score) FILTER (known AND layer = 'survival') * 1.0 / sum(weight) FILTER (known AND layer = 'survival') + 0.5) AS INT) AS survival,
  CAST(max(score) FILTER (layer = 'superpower') AS INT) AS superpower, CAST(floor((sum(weight * score) FILTER (known AND layer = 'survival') + 1500) * 1.0 / (sum(weight) FILTER (known AND layer = 'survival') + 15) + 0.5) AS INT) AS full_marks
  FROM k GROUP BY page_id),
s2 AS (SELECT page_id, overall, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade, coverage, survival, superpower,
  CASE WHEN superpower < 100 THEN full_marks END AS opportunity FROM s1)"""


def results(spark: SparkSession, sf_dir: str, kept: bool = True) -> DataFrame:
    """Outcomes of all checks; ``kept`` where they are used more than once."""
    out = audit.run_checks(site(spark, sf_dir), sidecars(spark, sf_dir))
    return cut(out) if kept else out


@query(f"WITH {AUDIT_SUMMARY_SQL} SELECT * FROM s2")
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to scores: six checks over one element table, summed up to a row a page."""
    return scoring.summarize(results(spark, sf_dir, kept=False))


@query(f"WITH {AUDIT_SQL} SELECT page_id, category, applicable, CAST(score AS INT) AS score FROM c")
def audit_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, kept=False).select("page_id", "category", "applicable", "score")


@query(f"WITH {AUDIT_SUMMARY_SQL} SELECT page_id, overall, grade, cats, scores FROM s2 JOIN (SELECT page_id, count(*) AS cats, string_agg(coalesce(CAST(CAST(score AS INT) AS VARCHAR), 'none'), ',' ORDER BY category) AS scores FROM c GROUP BY page_id) USING (page_id)")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON texts, read again."""
    shape = "overall int, grade string, categories array<struct<category:string,score:int,findings:array<struct<id:string>>>>"
    r = audit.reports(results(spark, sf_dir)).select("page_id", F.from_json("report", shape).alias("r"))
    scores = F.array_join(F.transform("r.categories", lambda c: F.coalesce(c["score"].cast("string"), F.lit("none"))), ",")
    return r.select("page_id", "r.overall", "r.grade", F.size("r.categories").cast("long").alias("cats"), scores.alias("scores"))


#: Bodies in several encodings, named by a header, a meta element or by nothing known.
ENCODED = """CASE page_id % 5 WHEN 0 THEN CAST(html AS BINARY) WHEN 1 THEN CAST('caf' AS BINARY) || unhex('E980') WHEN 2 THEN CAST('<meta charset=windows-1251>' AS BINARY) || unhex('CFF0')
WHEN 3 THEN CAST('a' AS BINARY) || unhex('FF') || CAST('b' AS BINARY) ELSE unhex('FEFF0041') END"""
ENCODED_TYPE = "CASE page_id % 5 WHEN 1 THEN 'text/html; charset=ISO-8859-1' WHEN 3 THEN 'text/html; charset=x-none' WHEN 4 THEN 'text/html; charset=\"utf-16be\"' END"


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN 'café€' WHEN 2 THEN '<meta charset=windows-1251>Пр' WHEN 3 THEN 'a' || chr(65533) || 'b' ELSE 'A' END AS body FROM pages")
def decode_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", net.decode_body(F.expr(ENCODED), F.expr(ENCODED_TYPE)).alias("body"))


@query("""SELECT page_id, CASE page_id % 7 WHEN 1 THEN CASE WHEN (page_id // 7 % 256) IN (0, 10, 127) OR page_id // 7 % 256 >= 224 THEN 'blocked-host' END WHEN 2 THEN 'invalid-url' WHEN 3 THEN 'blocked-host' WHEN 5 THEN 'blocked-host' WHEN 6 THEN 'invalid-url' END AS reason FROM pages""")
def validate_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs whose hosts are addresses in their several forms."""
    n = F.col("page_id")
    host = F.when(n % 7 == 0, "[2606:4700::1]").when(n % 7 == 1, F.concat(F.lit("0x"), F.hex(F.floor(n / 7) % 256), F.lit(".200.1.1"))).when(n % 7 == 2, "[1::2::3]")
    host = host.when(n % 7 == 3, "[::ffff:127.0.0.1]").when(n % 7 == 4, "[2002:808:808::]").when(n % 7 == 5, "2130706433").otherwise("1.2.3.256")
    return table(spark, sf_dir, "pages").select("page_id", net.reject_reason(F.concat(F.lit("http://"), host, F.lit("/"))).alias("reason"))


@query(f"""WITH {AUDIT_SUMMARY_SQL}, lamp AS (SELECT page_id, step, sum(weight * score) FILTER (known) * 1.0 / nullif(sum(weight) FILTER (known), 0) AS m FROM k GROUP BY page_id, step),
l2 AS (SELECT page_id, step, CASE WHEN m IS NULL THEN 'off' WHEN m >= 75 THEN 'pass' WHEN m >= 40 THEN 'warn' ELSE 'fail' END AS state FROM lamp)
SELECT page_id, overall, grade, CASE WHEN overall >= 75 THEN 'pass' WHEN overall >= 40 THEN 'warn' ELSE 'fail' END AS colour, max(state) FILTER (step = 'find') AS find, max(state) FILTER (step = 'understand') AS understand,
  max(state) FILTER (step = 'act') AS act, CASE WHEN opportunity > overall THEN '+' || (opportunity - overall) || ' to ' || opportunity END AS label FROM s2 JOIN l2 USING (page_id) GROUP BY page_id, overall, grade, opportunity""")
def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cards(results(spark, sf_dir))


@query("""WITH s AS (SELECT page_id, page_id % 5 AS r, page_id % 3 AS s, page_id % 4 AS l, page_id % 7 AS w FROM pages)
SELECT page_id, 8 - u AS observed, u AS unobserved, CAST(r = 1 AS INT) + CAST(s = 1 AS INT) + CAST(l = 2 AS INT) + CASE WHEN w = 6 THEN 0 WHEN w <= 2 THEN 4 ELSE 5 END AS missing
FROM (SELECT *, CAST(r = 0 AS INT) + CAST(s = 2 AS INT) + CAST(l = 3 AS INT) + CASE WHEN w = 6 THEN 5 ELSE 0 END AS u FROM s)""")
def sidecar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.sidecar_counts(sidecars(spark, sf_dir))


ORIGIN_SQL = "lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"


@query(f"""WITH t(key, path, ord) AS (VALUES {', '.join(f"('{k}', '{p}', {i})" for i, (k, p) in enumerate(discovery.TARGETS))})
SELECT origin, key, path, ord, origin || path AS target FROM (SELECT DISTINCT {ORIGIN_SQL} AS origin FROM pages) CROSS JOIN t""")
def sidecar_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.sidecar_targets(table(spark, sf_dir, "pages"))


@query(f"""SELECT page_id, ord, key, o || path AS target FROM (SELECT page_id, {ORIGIN_SQL} AS o, page_id % 8 AS k FROM pages)
JOIN (VALUES (6, 1, 'linked-openapi', '/api/openapi.json'), (7, 1, 'linked-feed', '/feed.xml'), (7, 2, 'linked-openapi', '/swagger.json')) v(k, ord, key, path) USING (k)""")
def linked_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site(spark, sf_dir)
    return discovery.linked_sidecars(pages, shred(pages))


@query("""SELECT page_id, k = 7 AS "left", 1 AS form_index_ok, CASE k WHEN 1 THEN 'a' WHEN 6 THEN 'n' END AS params, CASE k WHEN 7 THEN NULL WHEN 1 THEN '{"type":"object","properties":{"a":{"type":"string","description":"a"}}}'
 WHEN 6 THEN '{"type":"object","properties":{"n":{"type":"string","description":"n"}},"required":["n"]}' END AS schema FROM (SELECT page_id, page_id % 8 AS k FROM pages) WHERE k IN (1, 6, 7)""")
def tool_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred(site(spark, sf_dir))
    params = tools.tool_params(nodes)
    names = params.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "name")))["name"], ",").alias("params"))
    got = tools.tool_forms(nodes).join(names, "page_id", "left").join(tools.input_schemas(params), "page_id", "left")
    return got.select("page_id", F.col("params").isNull().alias("left"), (F.col("form_index") + 1).cast("int").alias("form_index_ok"), "params", "schema")


#: A form whose name comes from its id, its name, its submit's text, or the heading before it; pages without one get a search.
NAMED_FORM = """CASE page_id % 5 WHEN 0 THEN html ELSE replace(html, '</article>', CASE page_id % 5 WHEN 1 THEN '<form id="Book-it' || page_id || '" action="/b?a=1&amp;b=2">' WHEN 2 THEN '<form name="n ' || page_id || '"><legend> Your
 order </legend>' ELSE '<form>' END || '<label for="q"></label><label for="q">Second</label><label>Wrap &lt;b&gt; <input id="q" name="q' || (page_id % 3) || '" required></label><input type="file" name="f"><textarea name="notes" aria-label="Notes"></textarea>'
 || CASE page_id % 5 WHEN 3 THEN '<button> Reserve a table </button>' ELSE '' END || '</form></article>') END"""


@query(f"""WITH v AS (SELECT page_id, page_id % 5 AS k, list_last(list_filter(list_transform(regexp_extract_all(split_part(html, '</article>', 1), '<h[1-3][^>]*>([^<]*)</h', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')) AS h, {{0}} AS o FROM pages),
n AS (SELECT * REPLACE (replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h) FROM v), n2 AS (SELECT *, CASE k WHEN 1 THEN 'Book-it' || page_id WHEN 2 THEN 'n ' || page_id WHEN 3 THEN 'Reserve a table' ELSE h END AS raw, CASE k WHEN 2 THEN 'Your order' ELSE coalesce(h, CASE k WHEN 3 THEN 'Reserve a table' END) END AS told FROM n),
m AS (SELECT *, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_+', ''), 40), '_+$', ''), ''), 'submit_form') AS name FROM n2),
d AS (SELECT *, coalesce(left(told, 120), 'Submit the ' || name || ' form') AS about FROM m)
SELECT page_id, CASE k WHEN 0 THEN 'search_site' ELSE name END AS tool_name, CASE k WHEN 0 THEN 'Search ' || o ELSE about END AS description,
CASE WHEN k > 0 THEN '<form' || CASE k WHEN 1 THEN ' id="Book-it' || page_id || '" action="/b?a=1&amp;b=2"' WHEN 2 THEN ' name="n ' || page_id || '"' ELSE '' END || ' toolname="' || name || '" tooldescription="'
 || replace(replace(replace(replace(about, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '">' || chr(10) || '  <input id="q" name="q' || (page_id % 3) || '" type="text" toolparamdescription="Wrap &lt;b&gt;">' || chr(10)
 || '  <textarea name="notes" toolparamdescription="Notes"></textarea>' || chr(10) || '</form>' END AS form_markup FROM d""".replace("{0}", "lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"))
def tool_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(NAMED_FORM).alias("html"))
    return tools.tool_stubs(pages, shred(pages)).select("page_id", "tool_name", "description", "form_markup")


#: An inline frame alone, one beside text, one beside a form, a frameset.
FRAMED = """CASE page_id % 6 WHEN 1 THEN '<body><p>See</p><iframe src="/a"></iframe></body>' WHEN 2 THEN replace(html, '</article>', '<iframe src="/a"></iframe></article>') WHEN 3 THEN '<body><iframe src="/a"></iframe><form></form></body>'
WHEN 4 THEN '<html><frameset><frame src="/a"></frameset></html>' WHEN 5 THEN '<main></main><iframe></iframe>' ELSE html END"""


@query(f"""SELECT page_id, html LIKE '%<frameset%' OR (html LIKE '%<iframe%' AND html NOT LIKE '%<form%' AND html NOT LIKE '%<main%' AND words < 30) AS frame_shell FROM (SELECT page_id, html, len(regexp_extract_all({TEXT_SQL}, '\\S+')) AS words FROM (SELECT page_id, {FRAMED} AS html FROM pages))""")
def frame_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(FRAMED).alias("html"))
    return gates.frame_shells(shred(pages, kept=False))


ANSWERS = """CASE page_id % 7 WHEN 1 THEN 'timeout' END AS failure, page_id % 11 <> 3 AS allowed, CASE page_id % 5 WHEN 1 THEN 'application/json' WHEN 2 THEN 'TEXT/HTML; charset=utf-8' ELSE 'text/html' END AS content_type,
CASE page_id % 4 WHEN 3 THEN 503 ELSE 200 END AS status, CASE page_id % 3 WHEN 2 THEN 'Attention Required! verify you are human' ELSE html END AS body"""


@query(f"""WITH a AS (SELECT page_id, {ANSWERS} FROM pages), c AS (SELECT *, CASE WHEN NOT allowed THEN 'robots-disallow' WHEN failure IS NOT NULL THEN failure WHEN content_type = 'application/json' THEN 'content-type'
 WHEN status >= 400 THEN 'http-error' WHEN NOT regexp_matches(left(body, 4096), '(?i)<html|<!doctype html|<body|<head|<div|<p[\\s>]') THEN 'not-html' END AS code FROM a)
SELECT page_id, code, CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in gates.TITLES.items())} END AS title,
CASE WHEN code = 'http-error' THEN CASE WHEN regexp_matches(lower(left(body, 20000)), 'captcha|cf-challenge|__cf_chl|are you a human|verify you are human|attention required') THEN 'challenge'
 WHEN regexp_matches(lower(left(body, 20000)), 'access denied|request blocked|akamai|perimeterx|datadome|imperva') AND length(body) < 20000 THEN 'block-page' END END AS challenge FROM c WHERE code IS NOT NULL""")
def blocked_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "pages").selectExpr("page_id", *answers())
    return gates.blocked_reports(a.withColumn("headers", F.create_map().cast("map<string,string>")))


def answers() -> list[str]:
    """The columns of ANSWERS one by one."""
    out, rest = [], ANSWERS
    for name in ("failure", "allowed", "content_type", "status", "body"):
        value, _, rest = rest.partition(f" AS {name}")
        out.append(f"{value.lstrip(', ').strip()} AS {name}")
    return out


REFRESH = """'<meta http-equiv=' || chr(34) || 'refresh' || chr(34) || ' content=' || chr(34) || (page_id % 8) || '; url=' || CASE page_id % 3 WHEN 0 THEN '/next' WHEN 1 THEN 'https://other.example/' ELSE url END || chr(34) || '>'"""


@query(f"""SELECT page_id, CASE WHEN page_id % 8 <= 5 AND page_id % 3 = 0 THEN {ORIGIN_SQL} || '/next' WHEN page_id % 8 <= 5 AND page_id % 3 = 2 THEN {ORIGIN_SQL}
  || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\\?[^#]*)', 1) END AS target FROM pages""")
def meta_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("body", F.expr(f"{REFRESH} || html"))
    return gates.meta_refresh(p)


HEX = "printf('%x', {0})"
A6, B6 = "page_id * 7919 % 65536", "page_id * 104729 % 65536"
#: Six kinds of address by page id: two groups in eight, with a dotted tail, short ones.
IPV6 = "CASE page_id % 6 WHEN 0 THEN {a} || ':' || {b} || '::1' WHEN 1 THEN '2001:db8::' || {a} WHEN 2 THEN '::ffff:' || (page_id % 256) || '.' || (page_id * 3 % 256) || '.1.2' WHEN 3 THEN '2002:' || {a} || ':' || {b} || '::' WHEN 4 THEN 'fe80::1%eth0' ELSE '2606:4700::' || {b} || ':0:1' END"


@query(f"""WITH v AS (SELECT page_id, page_id % 6 AS k, {A6} AS a, {B6} AS b, {IPV6.format(a=HEX.format(A6), b=HEX.format(B6))} AS ip FROM pages), q AS (SELECT *, CASE k WHEN 2 THEN page_id % 256 WHEN 3 THEN a // 256 END AS x, CASE k WHEN 2 THEN page_id * 3 % 256 WHEN 3 THEN a % 256 END AS y FROM v)
SELECT page_id, ip, concat_ws(',', CASE k WHEN 0 THEN a || ',' || b || ',0,0,0,0,0,1' WHEN 1 THEN '8193,3512,0,0,0,0,0,' || a WHEN 2 THEN '0,0,0,0,0,65535,' || ((page_id % 256) * 256 + page_id * 3 % 256) || ',258' WHEN 3 THEN '8194,' || a || ',' || b || ',0,0,0,0,0'
 WHEN 4 THEN '65152,0,0,0,0,0,0,1' ELSE '9734,18176,0,0,0,' || b || ',0,1' END) AS groups,
CASE WHEN k IN (1, 4) THEN 'blocked' WHEN k = 5 THEN 'global' WHEN k = 0 THEN CASE WHEN a BETWEEN 8192 AND 16383 AND NOT (a = 8193 AND b IN (0, 3512)) THEN CASE WHEN a = 8194 THEN 'embedded' ELSE 'global' END ELSE 'blocked' END
 ELSE CASE WHEN x IN (0, 10, 127) OR x >= 224 OR (x = 100 AND y BETWEEN 64 AND 127) OR (x = 169 AND y = 254) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND y IN (0, 168)) OR (x = 198 AND y IN (18, 19, 51)) OR (x = 203 AND y = 0) THEN 'blocked' ELSE 'global' END END AS class FROM q""")
def classify_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = IPV6.format(a=f"lower(hex({A6}))", b=f"lower(hex({B6}))")
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(spoken).alias("ip"))
    groups = F.array_join(net.expand_ipv6(F.col("ip")).cast("array<string>"), ",")
    return p.select("page_id", "ip", groups.alias("groups"), net.classify_ipv6(F.col("ip")).alias("class"))


NUMBER = "page_id * 2654435761 % 4294967296"


@query(f"""WITH v AS (SELECT page_id, {NUMBER} AS n FROM pages) SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) END AS quad FROM v""")
def ipv4_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr(NUMBER)
    host = F.when(F.col("page_id") % 4 == 0, n.cast("string")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("0x"), F.hex(n)))
    host = host.when(F.col("page_id") % 4 == 2, F.concat(F.lit("0"), F.conv(F.shiftright(n, 24).cast("string"), 10, 8), F.lit("."), n.bitwiseAND(0xFFFFFF).cast("string"))).otherwise("999.1.1.1.1")
    return table(spark, sf_dir, "pages").select("page_id", net.ipv4_normalise(host).alias("quad"))


@query("""SELECT page_id, page_id % 3 <> 1 AND page_id % 5 <> 4 AND NOT ((page_id * 37) % 256 IN (0, 10, 127) OR (page_id * 37) % 256 >= 224) AS ok FROM pages""")
def all_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.expr("concat_ws('.', (page_id * 37) % 256, 200, page_id % 256, 1)")
    n = F.col("page_id")
    addresses = F.when(n % 3 == 1, F.array().cast("array<string>")).when(n % 5 == 4, F.array(a, F.lit("::1"))).otherwise(F.array(a, F.lit("2606:4700::1111")))
    return table(spark, sf_dir, "pages").select("page_id", net.all_global(addresses).alias("ok"))


@query("""SELECT page_id, concat_ws(';', 'content-type=text/html', 'x-long=' || CAST(least(2048, page_id % 3000) AS VARCHAR)) AS headers FROM pages""")
def capture_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.create_map(F.lit("Set-Cookie"), F.lit("a=b"), F.lit("Content-Type"), F.lit("text/html"), F.lit("X-Long"), F.repeat(F.lit("x"), (F.col("page_id") % 3000).cast("int")))
    p = table(spark, sf_dir, "pages").select("page_id", net.capture_headers(raw).alias("h"))
    return p.select("page_id", F.concat_ws(";", F.concat(F.lit("content-type="), F.col("h")["content-type"]), F.concat(F.lit("x-long="), F.length(F.col("h")["x-long"]).cast("string"))).alias("headers"))


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN o || '/b/c?x=1' WHEN 1 THEN o || '/d' WHEN 2 THEN regexp_extract(o, '^[a-z]+:', 0) || '//cdn.example/x' WHEN 3 THEN 'https://other.example/z' END AS target
FROM (SELECT page_id, {ORIGIN_SQL} AS o FROM pages)""")
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 5
    href = F.when(n == 0, "/a/../b/./c?x=1#f").when(n == 1, "../../d").when(n == 2, "//CDN.example/x").when(n == 3, "HTTPS://Other.example:443/y/../z").otherwise("mailto:a@b.example")
    base = F.concat(net.origin(F.col("url")), F.lit("/p/q/"))
    return table(spark, sf_dir, "pages").select("page_id", net.url_resolve(href, base).alias("target"))


@query("""SELECT conv_id, turn, '"' || replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || '"' AS json FROM conversations""")
def json_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.json_string(F.col("text")).alias("json"))


#: A page's URL in a form that browsers read as another text.
SPELLED = """CASE page_id % 10 WHEN 0 THEN 'HTTP://H' || page_id || '.Example.COM' WHEN 1 THEN 'https:h' || page_id || '.example.com/a/./b/../c' WHEN 2 THEN 'http://h' || page_id || '.example.com:0080/?q=' || page_id || ' x'
WHEN 3 THEN 'http://%68' || page_id || '.example.com/%7e' WHEN 4 THEN 'https:\\\\h' || page_id || '.example.com\\p\\..\\q' WHEN 5 THEN 'http://' || (134744072 + page_id) || '/x' WHEN 6 THEN 'http://0x0a.' || page_id || '/'
WHEN 7 THEN 'https://bücher' || page_id || '.example/é' WHEN 8 THEN 'http://h' || page_id || '.example.com:99999/' ELSE 'https://[2606:4700:0:0:0:0:0:' || (page_id % 10) || ']:443/%2E%2e/z#f' END"""


@query(f"""WITH v AS (SELECT page_id, page_id % 10 AS k, {SPELLED.replace(chr(92) * 2, chr(92))} AS url, 134744072 + page_id AS n FROM pages)
SELECT page_id, CASE k WHEN 6 THEN 'blocked-host' WHEN 8 THEN 'invalid-url' END AS reason, CASE k WHEN 0 THEN 'http://h' || page_id || '.example.com/' WHEN 1 THEN 'https://h' || page_id || '.example.com/a/c' WHEN 2 THEN 'http://h' || page_id || '.example.com/?q=' || page_id || '%20x'
WHEN 3 THEN 'http://h' || page_id || '.example.com/%7e' WHEN 4 THEN 'https://h' || page_id || '.example.com/q' WHEN 5 THEN 'http://' || concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) || '/x'
WHEN 9 THEN 'https://[2606:4700::' || (page_id % 10) || ']/z' END AS value FROM v WHERE k <> 7
UNION ALL SELECT page_id, NULL, NULL FROM v WHERE k = 7""")
def browser_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as browsers read them: spelled hosts, addresses, ports, dot segments and escapes; names beyond ASCII by reason alone."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(SPELLED.replace("\\", "\\\\").replace("\\\\\\\\", "\\\\")).alias("url"))
    p = p.select("page_id", net.url_of(F.col("url")).alias("u")).withColumn("reason", net.broken_rule(F.col("u")))
    return p.select("page_id", "reason", F.when(F.col("reason").isNull() & (F.col("page_id") % 10 != 7), net.written(F.col("u"))).alias("value"))


#: Recorded answers by page id: ends, chains of one to four hops, no location, a downgrade, a loop, another origin, and one page that many lead to.
ANSWERED = """CASE WHEN page_id % 8 = 0 THEN 200 WHEN page_id % 8 = 2 THEN 302 WHEN page_id % 8 = 4 THEN 308 ELSE 301 END AS status,
CASE page_id % 8 WHEN 1 THEN 'p' || (page_id - 1) WHEN 2 THEN '/x/../p' || (page_id - 1) WHEN 3 THEN 'https://h.example/p' || (page_id - 1) || '#f' WHEN 4 THEN '../p' || (page_id - 1) WHEN 6 THEN 'http://h.example/p0'
WHEN 7 THEN CASE page_id % 3 WHEN 0 THEN 'p' || page_id WHEN 1 THEN 'https://o.example/' ELSE 'p0' END END AS location"""


@query(f"""WITH RECURSIVE a AS (SELECT page_id AS id, page_id % 8 AS k, {ANSWERED} FROM pages),
e AS (SELECT id, k, CASE WHEN k BETWEEN 1 AND 4 THEN id - 1 WHEN k = 7 THEN CASE id % 3 WHEN 0 THEN id WHEN 2 THEN 0 END END AS next, k = 7 AND id % 3 = 1 AS away FROM a),
w AS (SELECT id AS page_id, id AS place, 0 AS hops FROM e UNION ALL SELECT w.page_id, e.next, hops + 1 FROM w JOIN e ON e.id = w.place WHERE hops < 3 AND e.next IS NOT NULL),
l AS (SELECT page_id, max_by(place, hops) AS place, max(hops) AS hops FROM w GROUP BY page_id)
SELECT page_id, 'https://h.example/p' || place AS final_url, CAST(hops AS INT) AS hops, CASE WHEN k = 0 THEN 'ok' WHEN k = 5 THEN 'redirect-invalid' WHEN hops = 3 THEN 'too-many-redirects' WHEN k = 6 THEN 'redirect-downgrade' WHEN away THEN 'redirect-invalid' END AS code FROM l JOIN e ON e.id = l.place""")
def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://h.example/p"), F.col("page_id").cast("string")).alias("url")
    pages = table(spark, sf_dir, "pages").select("page_id", url)
    answers = table(spark, sf_dir, "pages").selectExpr("concat('https://h.example/p', page_id) AS url", *ANSWERED_COLUMNS)
    return redirects.follow_redirects(pages, answers, same_origin=True).select("page_id", "final_url", "hops", "code")


ANSWERED_COLUMNS = [f"{ANSWERED.partition(' AS status,')[0]} AS status", f"{ANSWERED.partition(' AS status,')[2].strip()}"]
