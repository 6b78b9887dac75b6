"""Queries over the element table of ``pages``. Some pages get parts that all lack, by one SQL rule in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import checks, elements, snippets
from auditlake.plans.catalog import query, table
from auditlake.sources.tables import register_functions

GOOD = '<form id="f"><label for="e">Email</label><input id="e" name="email" type="email" autocomplete="email" required><button type="submit">Send</button></form>'
BAD = '<form><input placeholder="Your email"><input placeholder="Phone"></form>'
LOOSE = '<label>City <input name="city" autocomplete="off"></label>'
SOUP = '<div onclick="a()">Buy now</div><div onclick="b()">x</div><span role="button">y</span><a href="#">z</a>'
HEAD = '<meta name="description" content="d"><meta property="og:title" content="t"><link rel="canonical" href="/c"><script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":["A","B"]},{"@type":"A"}]}</script></head>'
BROKEN = '<script type="application/ld+json">{"@type":</script></head>'
#: The same text in Spark's and DuckDB's SQL.
VARIANT = f"""CASE page_id % 10 WHEN 1 THEN replace(html, '</article>', '{GOOD}</article>') WHEN 2 THEN replace(html, '</article>', '{BAD}</article>')
WHEN 3 THEN replace(html, '</article>', '{LOOSE}</article>') WHEN 5 THEN replace(html, '</article>', '{SOUP}</article>')
WHEN 6 THEN replace(replace(html, '</head>', '{HEAD}'), '<nav>', '<main></main><nav>') WHEN 7 THEN replace(html, '</head>', '{BROKEN}')
WHEN 9 THEN replace(html, '</article>', '<h4>x</h4></article>') ELSE html END"""
V_SQL = f"v AS (SELECT page_id, page_id % 10 AS k, {VARIANT} AS html FROM pages)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(VARIANT).alias("html"))


def plain(check: DataFrame) -> DataFrame:
    ids = F.concat_ws(",", F.array_sort(F.transform("findings", lambda f: f["id"])))
    return check.select("page_id", "applicable", "score", "confidence", ids.alias("ids"))


HEADS_SQL = f"""{V_SQL}, h AS (SELECT page_id, k, html, list_transform(regexp_extract_all(html, '<h([1-6])[ >]', 1), lambda x: CAST(x AS INT)) AS l FROM v),
s AS (SELECT *, len(l) AS headings, len(list_filter(l, lambda x: x = 1)) AS h1s, len(list_filter(range(2, len(l) + 1), lambda i: l[i] > l[i - 1] + 1)) AS skips FROM h)"""


@query(f"WITH {HEADS_SQL} SELECT page_id, headings, h1s, skips FROM s WHERE headings > 0")
def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.heading_stats(elements.shred(variants(spark, sf_dir), kept=False))


@query("""WITH l AS (SELECT page_id, html, list_transform(regexp_extract_all(html, '<[uo]l[^>]*>.*?</[uo]l>', 0, 's'), lambda x: len(regexp_extract_all(x, '<li[ >]'))) AS n FROM pages)
SELECT page_id, coalesce(list_max(n), 0) AS max_li, len(regexp_extract_all(html, '<article[ >]')) AS articles FROM l WHERE len(n) > 0 OR html LIKE '%<article%'""")
def max_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.list_stats(elements.shred(table(spark, sf_dir, "pages"), kept=False))


@query(f"WITH {V_SQL} SELECT page_id, 1 AS blocks, CASE k WHEN 6 THEN 1 ELSE 0 END AS valid, CASE k WHEN 6 THEN 1 ELSE 0 END AS schema_org, CASE k WHEN 6 THEN 'A,B' ELSE '' END AS types FROM v WHERE k IN (6, 7)")
def jsonld_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.jsonld_stats(elements.shred(variants(spark, sf_dir), kept=False)).withColumn("types", F.array_join("types", ","))



@query(f"""WITH c(k, ord, name, owned, submits) AS (VALUES (1, 1, 'Email', true, true), (2, 1, NULL, true, false), (2, 2, NULL, true, false), (3, 1, 'City', false, false)), {V_SQL}
SELECT page_id, ord, name, owned, submits FROM v JOIN c USING (k)""")
def form_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = elements.controls(elements.shred(variants(spark, sf_dir)))
    ord_ = F.expr("row_number() OVER (PARTITION BY page_id ORDER BY tag <> 'input', pre)")
    return c.select("page_id", ord_.alias("ord"), "name", F.col("owned_by").isNotNull().alias("owned"), "submits")


@query(f"SELECT page_id, CASE WHEN k = 2 THEN 'input:nth-of-type(1)|input:nth-of-type(2)' END AS ends FROM (WITH {V_SQL} SELECT * FROM v) WHERE k = 2")
def evidence_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three controls without a name of each page, by the ends of their paths."""
    nodes = elements.shred(variants(spark, sf_dir))
    nameless = elements.controls(nodes).where("name IS NULL").select("page_id", "pre").join(nodes.select("page_id", "pre", "path"), ["page_id", "pre"])
    ends = F.array_join(F.transform("paths", lambda p: F.trim(F.element_at(F.split(p, ">"), -1))), "|")
    return elements.samples(nameless, 3).select("page_id", ends.alias("ends"))


@query(f"""WITH {HEADS_SQL}, f AS (SELECT *, regexp_matches(html, '<title>[^<]*\\S[^<]*</title>') AS t, k = 6 AS d, html LIKE '%<main%' AS m, html LIKE '%<nav%' AS n,
html LIKE '%<footer%' OR html LIKE '%<header%' AS e, regexp_matches(html, '<html[^>]* lang="[^"]') AS g FROM s)
SELECT page_id, true AS applicable, CAST(CASE k WHEN 6 THEN 30 WHEN 7 THEN 10 ELSE 0 END + CASE WHEN t AND d THEN 10 WHEN t THEN 5 ELSE 0 END + CASE WHEN d THEN 10 ELSE 0 END
+ CASE WHEN m THEN 10 ELSE 0 END + CASE WHEN n THEN 5 ELSE 0 END + CASE WHEN e THEN 5 ELSE 0 END + CASE WHEN h1s = 1 THEN 10 WHEN h1s > 1 THEN 5 ELSE 0 END
+ CASE WHEN headings = 0 THEN 0 WHEN skips = 0 THEN 10 ELSE 5 END + CASE WHEN g THEN 5 ELSE 0 END AS INT) AS score, 'high' AS confidence,
concat_ws(',', CASE WHEN NOT (g AND d) THEN 'structure.document.meta' END, CASE WHEN h1s <> 1 OR skips > 0 THEN 'structure.headings.hierarchy' ELSE 'structure.headings.ok' END,
CASE k WHEN 6 THEN 'structure.jsonld.present' WHEN 7 THEN 'structure.jsonld.invalid' ELSE 'structure.jsonld.missing' END,
CASE WHEN m THEN 'structure.landmarks.present' ELSE 'structure.landmarks.no-main' END, CASE WHEN NOT (t AND d) THEN 'structure.meta.incomplete' END,
CASE WHEN NOT d THEN 'structure.og.missing' END) AS ids FROM f""")
def check_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = variants(spark, sf_dir)
    return plain(checks.check_structure(pages, elements.shred(pages, kept=False)))


@query(f"""WITH c(k, score, ids) AS (VALUES (1, 100, 'forms.autocomplete.ok,forms.label.ok,forms.required.ok,forms.submit.ok,forms.type.ok'),
(2, 35, 'forms.label.missing,forms.label.placeholder-only,forms.name.missing,forms.submit.missing'),
(3, 75, 'forms.autocomplete.off,forms.label.ok,forms.no-form-element,forms.submit.missing')), {V_SQL}
SELECT page_id, score IS NOT NULL AS applicable, score, 'high' AS confidence, coalesce(ids, 'forms.none') AS ids FROM v LEFT JOIN c USING (k)""")
def check_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = variants(spark, sf_dir)
    return plain(checks.check_forms(pages, elements.shred(pages, kept=False)))


@query(f"""WITH {V_SQL}, a AS (SELECT page_id, k, html, len(regexp_extract_all(html, '<a [^>]*href="[^"#]')) + CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS native,
CASE k WHEN 5 THEN 4 ELSE 0 END AS soup, k IN (1, 2) OR len(list_filter(regexp_extract_all(html, '<a [^>]*href="[^"#][^"]*"[^>]*>([^<]*)</a>', 1), lambda x: regexp_matches(x, '(?i){checks.MAIN_ACTION}'))) > 0 AS main FROM v)
SELECT page_id, native + soup > 0 AS applicable, CASE WHEN native + soup = 0 THEN NULL WHEN native = 0 THEN 0 ELSE CAST(floor(70.0 * native / (native + soup) + 0.5) AS INT) + 15 + CASE WHEN main OR soup = 0 THEN 15 ELSE 0 END END AS score,
CASE WHEN soup > 0 OR html NOT LIKE '%<script src%' THEN 'high' ELSE 'medium' END AS confidence,
CASE WHEN native + soup = 0 THEN 'actions.none' ELSE concat_ws(',', CASE WHEN soup = 0 THEN 'actions.native.ok' END, CASE WHEN main THEN 'actions.primary.native' WHEN soup > 0 THEN 'actions.primary.soup' END,
CASE WHEN soup > 0 THEN 'actions.soup.dead-links,actions.soup.handlers,actions.soup.role-only' END) END AS ids FROM a""")
def check_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = variants(spark, sf_dir)
    return plain(checks.check_actions(pages, elements.shred(pages, kept=False)))


@query("""WITH l AS (SELECT page_id, html FROM pages), a AS (SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=')) AS links, len(regexp_extract_all(html, '<h[1-6][ >]')) AS heads, len(regexp_extract_all(html, '<p[ >]')) AS paras FROM l)
SELECT page_id, links, heads, paras FROM a""")
def sql_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements counted in SQL alone, over the table function that reads pages."""
    register_functions(spark)
    return spark.sql(
        """SELECT page_id, count_if(tag = 'a' AND attrs['href'] IS NOT NULL) AS links, count_if(tag RLIKE '^h[1-6]$') AS heads, count_if(tag = 'p') AS paras
        FROM page_elements(TABLE(SELECT page_id, html FROM {pages})) GROUP BY page_id""", pages=table(spark, sf_dir, "pages"),
    )


#: A form of a page's own: a select with options, a mistyped input, a text area, each with what its name suggests.
TO_WRITE = """replace(html, '</article>', '<form><label for="c' || page_id || '">Country &amp; "region"</label><select id="c' || page_id || '" name="country" required><option value="a' || page_id || '">A &lt;1&gt;</option><option selected> Second
 one</option></select><input name="user_email" placeholder="Your e-mail"><textarea name="street" autocomplete="off">1 Way</textarea></form></article>')"""


@query("""SELECT page_id, ord, CASE ord WHEN 1 THEN '<label for="c' || page_id || '">Country &amp; &quot;region&quot;</label>' || chr(10) || '<select id="c' || page_id || '" name="country" autocomplete="country" required>' || chr(10)
|| '  <option value="a' || page_id || '">A &lt;1&gt;</option>' || chr(10) || '  <option value="Second one" selected>Second one</option>' || chr(10) || '</select>'
WHEN 2 THEN '<label for="user_email">Your e-mail</label>' || chr(10) || '<input id="user_email" name="user_email" type="email" autocomplete="email">'
ELSE '<label for="street">street</label>' || chr(10) || '<textarea id="street" name="street" autocomplete="street-address">1 Way</textarea>' END AS markup FROM pages, (SELECT unnest(range(1, 4)) AS ord) WHERE html LIKE '%</article>%'""")
def form_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(TO_WRITE).alias("html"))
    rows = snippets.form_snippets(elements.shred(pages))
    return rows.select("page_id", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY pre)").cast("long").alias("ord"), "markup")
