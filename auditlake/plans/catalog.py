"""Queries over the tables, and the same in DuckDB's SQL.

Scores, findings, headers and robots bodies are synthetic, made from page ids by one rule in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import net, text
from auditlake.operators import limiter, robots, rollups, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SPACE = text.SPACE


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple]) -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else quoted(x) for x in r) + ")" for r in rows)


# ---- scores -----------------------------------------------------------------------------------------------------


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = scoring.rubric(spark).select(F.col("ord").alias("cat"), "category")
    h = F.col("page_id") * 7 + F.col("cat") * 13
    pages = table(spark, sf_dir, "pages").select("page_id").crossJoin(F.broadcast(cats))
    score = F.when(h % 11 != 0, h % 101).cast("int")
    return pages.select("page_id", "category", ((F.col("page_id") + F.col("cat")) % 7 != 0).alias("applicable"), score.alias("score"))


RUBRIC_SQL = values([(i, *r) for i, r in enumerate(scoring.RUBRIC)])
RESULTS_SQL = f"""rubric(ord, category, weight, step, layer) AS ({RUBRIC_SQL}),
r AS (SELECT p.page_id, c.*, (p.page_id + c.ord) % 7 <> 0 AS applicable,
  CASE WHEN (p.page_id * 7 + c.ord * 13) % 11 = 0 THEN NULL ELSE (p.page_id * 7 + c.ord * 13) % 101 END AS score FROM pages p CROSS JOIN rubric c),
k AS (SELECT *, applicable AND score IS NOT NULL AS known FROM r),
s AS (SELECT page_id,
  CAST(floor(sum(weight * score) FILTER (known) * 1.0 / nullif(sum(weight) FILTER (known), 0) + 0.5) AS INT) AS overall,
  floor(coalesce(sum(weight) FILTER (known) * 1.0 / nullif(sum(weight) FILTER (applicable), 0), 0) * 100 + 0.5) / 100 AS coverage,
  CAST(floor(sum(weight * score) FILTER (known AND layer = 'survival') * 1.0 / nullif(sum(weight) FILTER (known AND layer = 'survival'), 0) + 0.5) AS INT) AS survival,
  CAST(max(score) FILTER (applicable AND layer = 'superpower') AS INT) AS superpower,
  CAST(floor((coalesce(sum(weight * score) FILTER (known AND layer = 'survival'), 0) + 1500) * 1.0 / (coalesce(sum(weight) FILTER (known AND layer = 'survival'), 0) + 15) + 0.5) AS INT) AS with_full,
  bool_or(layer = 'superpower' AND applicable AND coalesce(score, 0) < 100) AS open FROM k GROUP BY page_id),
summary AS (SELECT page_id, overall, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' WHEN overall IS NOT NULL THEN 'F' END AS grade,
  coverage, survival, superpower, CASE WHEN overall IS NOT NULL AND open THEN with_full END AS opportunity FROM s)"""


@query(f"WITH {RESULTS_SQL} SELECT * FROM summary")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summarize(results(spark, sf_dir))


@query(f"WITH {RESULTS_SQL} SELECT page_id, overall FROM summary")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summarize(results(spark, sf_dir)).select("page_id", "overall")


@query(f"WITH {RESULTS_SQL} SELECT page_id, overall, opportunity FROM summary")
def opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summarize(results(spark, sf_dir)).select("page_id", "overall", "opportunity")


@query(f"WITH {RESULTS_SQL} SELECT grade, count(*) AS pages FROM summary GROUP BY grade")
def letter_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summarize(results(spark, sf_dir)).groupBy("grade").agg(F.count("*").alias("pages"))


@query(f"WITH {RESULTS_SQL} SELECT page_id, CASE WHEN opportunity > overall THEN '+' || (opportunity - overall) || ' to ' || opportunity END AS label FROM summary")
def opportunity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.opportunity_labels(scoring.summarize(results(spark, sf_dir)))


@query(f"""WITH {RESULTS_SQL} SELECT page_id, category, CASE WHEN applicable THEN floor(weight * 1.0 / sum(CASE WHEN applicable THEN weight END) OVER (PARTITION BY page_id) * 1000 + 0.5) / 10 ELSE 0.0 END AS effective_weight FROM r""")
def category_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_weights(results(spark, sf_dir))


@query(f"""WITH {RESULTS_SQL}, m AS (SELECT page_id, step, sum(weight * score) FILTER (known) * 1.0 / nullif(sum(weight) FILTER (known), 0) AS mean FROM k GROUP BY page_id, step)
SELECT page_id, step, CASE WHEN mean IS NULL THEN 'off' WHEN mean >= 75 THEN 'pass' WHEN mean >= 40 THEN 'warn' ELSE 'fail' END AS state FROM m""")
def step_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.step_states(results(spark, sf_dir))


# ---- findings ---------------------------------------------------------------------------------------------------


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = scoring.rubric(spark).select(F.col("ord").alias("cat"), "category")
    p = table(spark, sf_dir, "pages").select("page_id").crossJoin(F.broadcast(cats)).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    h = F.col("page_id") * 5 + F.col("cat") * 3 + F.col("ord")
    severity = F.element_at(F.array(*map(F.lit, scoring.SEVERITY)), (h % 5 + 1).cast("int"))
    ident = F.concat("category", F.lit("."), F.when(h % 9 == 0, "unobserved").otherwise(F.concat(F.lit("f"), F.col("ord").cast("string"))))
    return p.select("page_id", "category", "ord", ident.alias("id"), severity.alias("severity"), (h % 4 == 0).alias("positive"))


FINDINGS_SQL = f"""rubric(cat, category, weight, step, layer) AS ({RUBRIC_SQL}), sev(sname, srank, sord) AS ({values([(k, v, i) for i, (k, v) in enumerate(scoring.SEVERITY.items())])}),
f AS (SELECT p.page_id, c.category, c.cat, c.weight, o.ord, p.page_id * 5 + c.cat * 3 + o.ord AS h FROM pages p CROSS JOIN rubric c CROSS JOIN (VALUES (0), (1), (2)) o(ord)),
ranked AS (SELECT page_id, category, category || '.f' || ord AS id, sname AS severity, CAST(srank * weight AS INT) AS priority,
  CAST(row_number() OVER (PARTITION BY page_id ORDER BY srank * weight DESC, cat, ord) AS INT) AS rank FROM f JOIN sev ON sord = h % 5 WHERE h % 4 <> 0 AND h % 9 <> 0)"""


@query(f"WITH {FINDINGS_SQL} SELECT * FROM ranked")
def rank_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank_findings(findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT * FROM ranked WHERE rank <= 3")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_findings(findings(spark, sf_dir), 3)


# ---- text -------------------------------------------------------------------------------------------------------

COLLAPSED = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length(t) > 300 THEN left(t, 299) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, {COLLAPSED} AS t FROM documents)")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT page_id, replace(replace(replace(replace(left(t, 60), '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM (SELECT page_id, " + COLLAPSED.replace("(text", "(html") + " AS t FROM pages)")
def escape_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.escape_attr(F.col("html")).alias("escaped"))


@query("SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+', ''), 40), '_+$', '') AS slug FROM documents")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


TAG, KIND = "CASE event_id % 4 WHEN 0 THEN 'select' WHEN 1 THEN 'textarea' ELSE 'input' END", "CASE event_id % 7 WHEN 0 THEN 'Number' WHEN 1 THEN 'range' WHEN 2 THEN 'checkbox' WHEN 3 THEN event_type WHEN 4 THEN 'EMAIL' END"


@query(f"SELECT event_id, CASE WHEN tag <> 'input' THEN 'string' WHEN lower(coalesce(kind, 'text')) IN ('number', 'range') THEN 'number' WHEN lower(coalesce(kind, 'text')) = 'checkbox' THEN 'boolean' ELSE 'string' END AS schema_type FROM (SELECT event_id, {TAG} AS tag, {KIND} AS kind FROM events)")
def schema_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.schema_type(F.expr(TAG), F.expr(KIND)).alias("schema_type"))


@query(f"SELECT doc_id, regexp_extract(lower(regexp_replace(text, '^{SPACE}+', '')), '^[^\\s/]*', 0) AS token FROM documents")
def product_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.product_token(F.col("text")).alias("token"))


FORWARDED = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' 10.0.' || (user_id % 256) || '.1 , 5.6.7.8' ELSE '10.1.' || (user_id % 256) || '.2' END"


@query(f"SELECT event_id, coalesce(nullif(trim(split_part({FORWARDED}, ',', 1)), ''), 'anon') AS client FROM events")
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.client_key(F.expr(FORWARDED)).alias("client"))


FIELDS = ("name", "email", "phone", "date", "time", "party_size", "notes")


@query("""SELECT conv_id, turn, 'name=' || left(role, 200) || ';notes=' || left(text, 200) AS kept FROM conversations""")
def reserve_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = F.create_map(F.lit("notes"), F.col("text"), F.lit("admin"), F.lit("true"), F.lit("name"), F.col("role"))
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.allowed_fields(sent, FIELDS, 200).alias("m"))
    return p.select("conv_id", "turn", F.concat(F.lit("name="), F.col("m")["name"], F.lit(";notes="), F.col("m")["notes"]).alias("kept"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, strlen(text) > 2048 AS truncated, CAST(least(strlen(text), 2048) AS BIGINT) AS kept FROM documents")
def truncate_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", net.cut_body(F.col("text").cast("binary"), 2048).alias("b"))
    return b.select("doc_id", "b.n_bytes", "b.truncated", F.octet_length("b.body").cast("long").alias("kept"))


#: Posted bodies: JSON, urlencoded, one too large, one that is no object, one of another type.
POSTED = """CASE turn % 5 WHEN 0 THEN '{"name":"' || role || '","admin":true,"party_size":' || conv_id || ',"notes":null}' WHEN 1 THEN 'name=' || role || '+%26' || conv_id || '&admin=1&notes=' || repeat('x', 300) || '&name=last%2'
WHEN 2 THEN '{"name":"' || repeat('y', 9000) || '"}' WHEN 3 THEN '[' || conv_id || ']' ELSE 'name=' || role END"""
POSTED_TYPE = "CASE turn % 5 WHEN 1 THEN 'application/x-www-form-urlencoded; charset=utf-8' WHEN 4 THEN 'multipart/form-data' ELSE 'application/json' END"


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 2 THEN 413 WHEN 3 THEN 400 WHEN 4 THEN 400 ELSE 200 END AS status, CASE turn % 5 WHEN 0 THEN role || '|' || conv_id || '|' WHEN 1 THEN 'last%2||' || repeat('x', 200) END AS kept FROM conversations""")
def reserve_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.reservation(F.expr(POSTED), F.expr(POSTED_TYPE)).alias("r"))
    field = lambda name: F.coalesce(F.col("r.fields")[name], F.lit(""))
    return c.select("conv_id", "turn", "r.status", F.when(F.col("r.status") == 200, F.concat_ws("|", field("name"), field("party_size"), field("notes"))).alias("kept"))


# ---- network ----------------------------------------------------------------------------------------------------

QUAD = "concat_ws('.', (page_id * 37) % 256, (page_id * 11) % 256, page_id % 256, (page_id * 3) % 256)"


@query(f"""SELECT page_id, ip, CASE WHEN a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b IN (18, 19, 51)) OR (a = 203 AND b = 0) THEN 'blocked' ELSE 'global' END AS class
FROM (SELECT page_id, {QUAD} AS ip, (page_id * 37) % 256 AS a, (page_id * 11) % 256 AS b FROM pages)""")
def classify_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(QUAD).alias("ip"))
    return p.select("page_id", "ip", net.classify_ipv4(F.col("ip")).alias("class"))


#: The page's URL, or one of the same text in a form that isn't fetched.
ASKED_URL = """CASE page_id % 9 WHEN 1 THEN regexp_replace(url, '^https?', 'ftp') WHEN 2 THEN regexp_replace(url, '://', '://u:p@') WHEN 3 THEN 'https://h' || page_id || '.example.com:' || (440 + page_id % 5) || '/'
WHEN 4 THEN 'https://' || (page_id * 37 % 256) || '.' || (page_id * 11 % 256) || '.0.9/x' WHEN 5 THEN 'no url ' || page_id WHEN 6 THEN 'https://a' || page_id || '.internal/' WHEN 7 THEN 'https://intranet' || page_id || '/' WHEN 8 THEN 'https://a..b' || page_id || '.com/' ELSE url END"""


@query(f"""WITH u AS (SELECT page_id, {ASKED_URL} AS u FROM pages), v AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth FROM u),
w AS (SELECT *, regexp_extract(auth, ':([0-9]+)$', 1) AS port, lower(regexp_extract(regexp_replace(auth, '^.*@', ''), '^([^:]*)', 1)) AS host FROM v),
x AS (SELECT *, regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') AS quad, TRY_CAST(split_part(host, '.', 1) AS INT) AS a, TRY_CAST(split_part(host, '.', 2) AS INT) AS b FROM w)
SELECT page_id, u AS url, CASE WHEN scheme = '' OR (scheme IN ('http', 'https') AND auth = '') THEN 'invalid-url' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN auth LIKE '%@%' THEN 'userinfo'
 WHEN port NOT IN ('', '80', '443') THEN 'port' WHEN quad AND (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b IN (18, 19, 51)) OR (a = 203 AND b = 0)) THEN 'blocked-host'
 WHEN NOT quad AND (host IN ('localhost', 'metadata') OR host LIKE '%.internal' OR host LIKE '%.local' OR host LIKE '%.localhost' OR host LIKE '%.arpa' OR host LIKE '%..%' OR host NOT LIKE '%.%') THEN 'blocked-host' END AS reason FROM x""")
def validate_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", F.expr(ASKED_URL).alias("url"))
    return u.withColumn("u", net.url_of(text.trim_space(F.col("url")))).select("page_id", "url", net.broken_rule(F.col("u")).alias("reason"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS origin,
  lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\\?[^#]*)', 1) AS path FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", net.origin(u).alias("origin"), net.host(u).alias("host"), net.path_query(u).alias("path"))


@query("""WITH raw AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN '' WHEN 3 THEN url || ' x' ELSE 'ftp://h.example.com' END AS raw, url FROM pages)
SELECT page_id, page_id % 5 <= 1 AS ok, CASE page_id % 5 WHEN 2 THEN 'empty' WHEN 3 THEN 'spaces' WHEN 4 THEN 'scheme' ELSE CASE WHEN page_id % 5 = 1 THEN 'https' ELSE regexp_extract(url, '^(https?)', 1) END || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))
  || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\\?[^#]*)', 1) END AS value FROM raw""")
def normalise_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, url = F.col("page_id") % 5, F.col("url")
    raw = F.when(v == 0, F.concat(F.lit("  "), url, F.lit(" "))).when(v == 1, F.regexp_replace(url, "^https?://", "")).when(v == 2, F.lit("")).when(v == 3, F.concat(url, F.lit(" x"))).otherwise("ftp://h.example.com")
    return net.normalise_urls(table(spark, sf_dir, "pages").select("page_id", raw.alias("url"))).select("page_id", "ok", "value")


TYPE = """CASE page_id % 7 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'TEXT/HTML' WHEN 2 THEN 'application/xhtml+xml;charset=' || chr(34) || 'iso-8859-' || (page_id % 9) || chr(34) WHEN 3 THEN 'application/v' || page_id || '+json'
WHEN 4 THEN 'nonsense ' || page_id WHEN 5 THEN 'text/plain; x=1; charset = ascii' END"""
MIME_SQL = f"""h AS (SELECT page_id, {TYPE} AS header FROM pages), m AS (SELECT *, CASE WHEN regexp_matches(lower(trim(split_part(header, ';', 1))), '^[a-z0-9][a-z0-9!#$&^_.+-]*/[a-z0-9][a-z0-9!#$&^_.+-]*$') THEN lower(trim(split_part(header, ';', 1))) END AS mime FROM h)"""


@query(f"WITH {MIME_SQL} SELECT page_id, mime, CASE WHEN mime IS NOT NULL THEN nullif(lower(trim(regexp_extract(header, '(?i);\\s*charset\\s*=([^;]*)', 1), ' ''\"')), '') END AS charset FROM m")
def media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", net.media_type(F.expr(TYPE)).alias("mime"), net.charset(F.expr(TYPE)).alias("charset"))


@query(f"WITH {MIME_SQL} SELECT page_id, coalesce(mime IN ('text/html', 'application/xhtml+xml') OR mime LIKE 'font/%', false) AS allowed FROM m")
def content_type_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", net.content_type_allowed(F.expr(TYPE), ["text/html", "application/xhtml+xml", "font/*"]).alias("allowed"))


BEGUN = """CASE page_id % 5 WHEN 0 THEN '<!-- x -->' || chr(10) || '<!DOCTYPE  html>y' WHEN 1 THEN '{' || page_id || '}' WHEN 2 THEN repeat(' ', CAST(4070 + page_id % 50 AS INT)) || '<header>' WHEN 3 THEN 'a <divider/>' ELSE html END"""


@query(f"SELECT page_id, regexp_matches(left(b, 4096), '(?i)<html|<!doctype html|<body|<head|<div|<p[\\s>]') OR regexp_matches(left(b, 4096), '(?is)^(\\s|<!--.*?-->|<\\?xml[^>]*\\?>)*<!doctype\\s+html\\b') AS html FROM (SELECT page_id, {BEGUN} AS b FROM pages)")
def looks_like_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", net.looks_like_html(F.expr(BEGUN)).alias("html"))


# ---- limiter ----------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, event_id, rn, t, [t] AS hits, true AS ok, CAST(0 AS BIGINT) AS wait FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, t, CASE WHEN len(h) < 2 THEN list_append(h, t) ELSE h END, len(h) < 2, CASE WHEN len(h) < 2 THEN 0 ELSE greatest(1, CAST(ceil((h[1] + 86400000000 - t) / 1000000.0) AS BIGINT)) END
  FROM (SELECT e.user_id, e.event_id, e.rn, e.t, list_filter(w.hits, lambda x: x > e.t - 86400000000) AS h FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1))
SELECT user_id, event_id, ok, wait AS retry_after_s FROM w""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.rate_limit(table(spark, sf_dir, "events"), window_ms=86_400_000, most=2)


# ---- robots -----------------------------------------------------------------------------------------------------

#: Rules by page id: one for all, one for a crawler of its own group, wildcards with an end, none.
RULES = """CASE page_id % 4 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /a' || chr(10) || 'Allow: /*e' WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: GPTBot/1.0' || chr(10) || 'User-agent: CCBot' || chr(10) || 'Disallow: /p'
WHEN 2 THEN '# note' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /*' || (page_id % 10) || '$' || chr(10) || 'Disallow:' ELSE 'nothing here' END"""
PATH_SQL = """CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\\?[^#]*)', 1)"""


@query(f"""WITH q AS (SELECT page_id, token, {PATH_SQL} AS path FROM pages CROSS JOIN (VALUES ('ccbot/2'), ('Other'), ('GPTBot')) t(token))
SELECT page_id, token, path, CASE page_id % 4 WHEN 0 THEN path LIKE '/%e%' OR path NOT LIKE '/a%' WHEN 1 THEN token <> 'Other' AND path NOT LIKE '/p%' WHEN 2 THEN NOT (path LIKE '/%' || (page_id % 10)) ELSE true END AS allowed FROM q""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("site"), F.expr(RULES).alias("body"), net.path_query(F.col("url")).alias("path"))
    asked = pages.select("site", F.explode(F.array(*map(F.lit, ("ccbot/2", "Other", "GPTBot")))).alias("token"), "path")
    return robots.robots_allowed(robots.parse_robots(pages.select("site", "body")), asked).withColumnRenamed("site", "page_id")


@query("""WITH b AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS k, page_id % 10 AS d FROM pages)
SELECT page_id, group_no, kind, replace(value, '#', CAST(d AS VARCHAR)) AS value FROM b JOIN (VALUES (0, 1, 'user-agent', '*'), (0, 1, 'disallow', '/a'), (0, 1, 'allow', '/*e'), (1, 1, 'user-agent', '*'), (1, 1, 'disallow', '/'),
(1, 2, 'user-agent', 'gptbot'), (1, 2, 'user-agent', 'ccbot'), (1, 2, 'disallow', '/p'), (2, 1, 'user-agent', '*'), (2, 1, 'disallow', '/*#$'), (2, 1, 'disallow', '')) v(k, group_no, kind, value) USING (k)""")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "pages").select(F.col("page_id").alias("site"), F.expr(RULES).alias("body"))
    return robots.parse_robots(bodies).select(F.col("site").alias("page_id"), F.col("group_no").cast("int").alias("group_no"), "kind", "value")


SLOTS = ("18:00", "18:30", "19:00", "19:30", "20:00", "20:30")


@query(f"SELECT page_id, slot, size, slot IN {SLOTS} AND size <= 8 AS available FROM (SELECT page_id, (17 + page_id % 5) || ':' || CASE page_id % 2 WHEN 0 THEN '00' ELSE '30' END AS slot, page_id % 12 AS size FROM pages)")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.concat((17 + F.col("page_id") % 5).cast("string"), F.lit(":"), F.when(F.col("page_id") % 2 == 0, "00").otherwise("30"))
    p = table(spark, sf_dir, "pages").select("page_id", slot.alias("slot"), (F.col("page_id") % 12).alias("size"))
    return p.select("*", (F.col("slot").isin(*SLOTS) & (F.col("size") <= 8)).alias("available"))


# ---- rollups ------------------------------------------------------------------------------------------------------


@query(f"""WITH {RESULTS_SQL}, m AS (SELECT page_id, step, sum(weight * score) FILTER (known) * 1.0 / nullif(sum(weight) FILTER (known), 0) AS mean FROM k GROUP BY page_id, step),
x AS (SELECT grade, overall, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '[0-9]+', '') AS host, step, coalesce(mean >= 75, false) AS pass FROM m JOIN summary USING (page_id) JOIN pages USING (page_id))
SELECT grade, host, step, CAST(grouping(grade, host, step) AS INT) AS level, CAST(CASE WHEN grouping(step) = 1 THEN count(*) // 3 ELSE count(*) END AS BIGINT) AS pages, count(*) FILTER (pass) AS passed,
floor(sum(overall) * 1.0 / count(overall) * 10 + 0.5) / 10 AS mean FROM x GROUP BY CUBE (grade, host, step)""")
def audit_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by host and step with all totals; numbers in hosts are left out, so that hosts have several pages."""
    plain = table(spark, sf_dir, "pages").select("page_id", F.concat(net.scheme(F.col("url")), F.lit("://"), F.regexp_replace(net.host(F.col("url")), "[0-9]+", "")).alias("url"))
    return rollups.audit_cube(plain, results(spark, sf_dir))
