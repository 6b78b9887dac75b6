"""What a site publishes for machines beside its pages: targets to ask for, links to follow, and the check of what came."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.net import origin, path_query, url_resolve
from auditlake.functions.text import round_half_up
from auditlake.functions.relations import refuse
from auditlake.operators.elements import attr
from auditlake.operators.rules import Context, Facts, Outcome, Rule, alone, finding, has, points
from auditlake.operators.robots import parse_robots, verdicts

#: What is asked for at every origin, and the crawlers that robots rules are tried for.
TARGETS = [
    ("robots.txt", "/robots.txt"), ("sitemap.xml", "/sitemap.xml"), ("llms.txt", "/llms.txt"), ("well-known", "/.well-known/oauth-protected-resource"),
    ("well-known", "/.well-known/mcp.json"), ("well-known", "/.well-known/mcp/server-card.json"), ("well-known", "/.well-known/ai-plugin.json"), ("well-known", "/.well-known/agent-card.json"),
]
CRAWLERS = """GPTBot ChatGPT-User OAI-SearchBot ClaudeBot Claude-User anthropic-ai Google-Extended PerplexityBot Bingbot CCBot Applebot-Extended Bytespider""".split()
FEEDS = ("application/rss+xml", "application/atom+xml", "application/feed+json")
MOST_LINKED, MANY_BLOCKED = 2, 4


def sidecar_targets(pages: DataFrame, url: str = "url") -> DataFrame:
    """(origin, key, path, ord, target) for every distinct origin of the pages."""
    origins = pages.select(origin(F.col(url)).alias("origin")).distinct()
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(p).alias("path"), F.lit(i).alias("ord")) for i, (k, p) in enumerate(TARGETS)])
    return origins.select("origin", F.inline(rows)).withColumn("target", F.concat("origin", "path"))


def linked_sidecars(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, ord, key, target): the first MOST_LINKED distinct feeds and API descriptions of a page's own origin that it links to."""
    rel, kind, href = (F.lower(F.coalesce(attr(a), F.lit(""))) for a in ("rel", "type", "href"))
    links = nodes.where(((F.col("tag") == "link") & attr("rel").isNotNull()) | ((F.col("tag") == "a") & attr("href").isNotNull()))
    feed = kind.contains("rss") | kind.contains("atom") | ((rel == "alternate") & (kind.contains("xml") | kind.contains("json")))
    api = rel.contains("openapi") | rel.contains("service-desc") | rel.contains("describedby") | kind.contains("openapi") | href.rlike(r"(openapi|swagger)[^/]*\.(json|ya?ml)\z")
    links = links.where((feed | api) & (F.coalesce(attr("href"), F.lit("")) != "")).select("page_id", "pre", F.when(api, "linked-openapi").otherwise("linked-feed").alias("key"), attr("href").alias("href"))
    site = pages.select("page_id", F.concat(origin(F.col("url")), F.lit("/")).alias("base"))
    links = links.join(site, "page_id").withColumn("target", url_resolve(F.col("href"), F.col("base")))
    links = links.where(F.concat(origin(F.col("target")), F.lit("/")) == F.col("base")).groupBy("page_id", "target").agg(F.min(F.struct("pre", "key")).alias("x"))
    ord_ = F.row_number().over(Window.partitionBy("page_id").orderBy("x.pre"))
    return links.withColumn("ord", ord_).where(F.col("ord") <= MOST_LINKED).select("page_id", "ord", F.col("x.key").alias("key"), "target")


def sidecar_counts(sidecars: DataFrame) -> DataFrame:
    """(page_id, observed, unobserved, missing): an answer of any status is observed; missing ones answered 404 or 410."""
    return sidecars.groupBy("page_id").agg(
        F.count_if("observed").alias("observed"), F.count_if(~F.col("observed")).alias("unobserved"), F.count_if(F.col("observed") & F.col("status").isin(404, 410)).alias("missing")
    )


def soft_missing(body: Column) -> Column:
    """A page of markup where a file was asked for."""
    return F.coalesce(F.left(body, F.lit(2048)).rlike("(?i)<html|<!doctype html|<body"), F.lit(False))


def json_facts(text: str | None) -> tuple[bool, bool, bool]:
    """Whether a text is a JSON object, a resource document of protected servers, a server card."""
    try:
        x = json.loads(text or "", parse_constant=refuse)
    except (ValueError, RecursionError):
        return False, False, False
    if not isinstance(x, dict):
        return False, False, False
    resource = isinstance(x.get("resource"), str) and isinstance(x.get("authorization_servers"), list)
    return True, resource, any(isinstance(x.get(k), str) for k in ("name", "url", "endpoint")) or isinstance(x.get("servers"), list)


@F.pandas_udf(T.StructType([T.StructField(n, T.BooleanType()) for n in ("object", "resource", "card")]))
def json_object(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([json_facts(x) for x in body], columns=["object", "resource", "card"])


def well_known() -> Column:
    """An aggregate: the well-known files that came and aren't markup, in order, each with its kind and what it holds."""
    kind = F.when(F.contains("path", F.lit("oauth-protected-resource")), "resource").when(F.col("path").rlike(r"/mcp\.json$|server-card\.json$"), "card").otherwise("other")
    return F.array_sort(F.collect_list(F.when((F.col("key") == "well-known") & F.col("came") & ~soft_missing(F.col("body")), F.struct("ord", kind.alias("kind"), F.col("j").alias("j")))))


def well_known_facts(files: Column) -> dict[str, Column]:
    """What the first resource document and the first card hold, and whether another file is a JSON object."""
    of = lambda kind: F.filter(files, lambda x: x["kind"] == kind)
    first = lambda kind, field: F.coalesce(F.get(of(kind), F.lit(0))["j"][field], F.lit(False))
    again = lambda x, i: F.exists(F.slice(files, F.lit(1), i), lambda y: y["kind"] == x["kind"])
    other = F.filter(files, lambda x, i: x["j"]["object"] & ((x["kind"] == "other") | again(x, i)))
    return {
        "resource": F.size(of("resource")) > 0, "resource_ok": first("resource", "resource"), "card": F.size(of("card")) > 0, "card_ok": first("card", "card"), "other": F.size(other) > 0,
    }


def robots_facts(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page_id, blocks_all, n_blocked, sitemaps) of ``bodies`` (page_id, body): equal texts are parsed once."""
    b = bodies.withColumn("site", F.sha2("body", 256))
    parsed = parse_robots(b.select("site", "body").dropDuplicates(["site"]))
    tokens = F.array(*[F.lit(t) for t in ["*", *[c.lower() for c in CRAWLERS]]]).alias("tokens")
    paths = F.explode(F.array_distinct(F.array(F.lit("/"), F.coalesce(path_query(F.col("url")), F.lit("/"))))).alias("path")
    asked = b.join(pages.select("page_id", "url"), "page_id").select("page_id", "site", "url", paths, tokens)
    got = verdicts(parsed, asked)
    page = F.col("path") == F.coalesce(path_query(F.col("url")), F.lit("/"))
    blocked = F.size(F.filter(F.slice("allowed", 2, len(CRAWLERS)), lambda x: ~x))
    return got.groupBy("page_id").agg((~F.bool_or(F.col("allowed")[0])).alias("blocks_all"), F.max(F.when(page, blocked)).alias("n_blocked"), F.max("sitemaps").alias("sitemaps"))


def discovery_marks() -> dict[str, Column]:
    rel, kind, href = F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"[ \t\n\f\r]+"), F.coalesce(attr("type"), F.lit("")), F.coalesce(attr("href"), F.lit(""))
    link, a = F.col("tag") == "link", F.col("tag") == "a"
    api = link & (F.array_contains(rel, "openapi") | F.array_contains(rel, "service-desc") | kind.contains("openapi")) | (a & (href.contains("openapi.") | href.contains("swagger.")))
    return {"api": api, "feed": link & kind.isin(*FEEDS)}


def discovery_facts(m: Facts) -> dict[str, Column]:
    return {"api_link": has(m("api")), "feed": has(m("feed"))}


def discovery_evidence(m: Facts) -> dict[str, tuple[Column, int]]:
    return {"api_paths": (m("api"), 2), "feed_paths": (m("feed"), 2)}


def sidecar_facts(context: Context) -> DataFrame:
    """Per page what its sidecars say, by one aggregation over them: which were observed, their bodies, well-known files; and robots rules for the page."""
    came = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    known = F.col("key") == "well-known"
    rows = context.sidecars.withColumn("came", came).withColumn("j", json_object(F.when(known & came, F.col("body"))))
    seen = lambda key: has((F.col("key") == key) & (F.col("observed") | F.col("came"))).alias(f"saw_{key[:4].replace('.', '_')}")
    mine = lambda key: (F.col("key") == key) & F.col("came")
    body = lambda key: F.min_by(F.when(mine(key), F.col("body")), F.when(mine(key), F.col("ord")))
    s = rows.groupBy("page_id").agg(
        seen("robots.txt"), seen("sitemap.xml"), seen("llms.txt"), seen("well-known"), body("robots.txt").alias("robots"), body("sitemap.xml").alias("sitemap"),
        body("llms.txt").alias("llms"), has(mine("linked-openapi")).alias("api_file"), well_known().alias("files"),
    )
    s = s.select("*", *[c.alias(n) for n, c in well_known_facts(F.col("files")).items()]).drop("files")
    rules = s.where(F.col("robots").isNotNull() & ~soft_missing(F.col("robots"))).select("page_id", F.col("robots").alias("body"))
    return s.drop("robots").join(robots_facts(context.pages, rules), "page_id", "left")


def discovery_steps(f: Facts) -> dict[str, Column]:
    flag, parsed, declared = f.yes, f("blocks_all").isNotNull(), f.n("sitemaps") > 0
    map_ok = F.coalesce(f("sitemap").rlike("(?i)<urlset|<sitemapindex"), F.lit(False))
    # Robots that block everything end the parse there: their sitemaps still count
    return {
        "rb": flag("saw_robo"), "parsed": parsed, "all": flag("blocks_all"), "open": parsed & ~flag("blocks_all"), "mp": flag("saw_site") | map_ok | declared, "map": map_ok | declared,
        "ll": flag("saw_llms"), "has_llms": f("llms").isNotNull() & ~soft_missing(f("llms")), "titled": F.coalesce(f("llms").rlike(r"(?m)^#\s+\S"), F.lit(False)),
        "api": flag("api_file") | flag("api_link"), "wk": flag("saw_well"), "mcp": flag("resource_ok") | flag("card_ok"), "mcp_any": flag("resource") | flag("card"),
    }


def discovery_points(f: Facts) -> dict[str, Column]:
    got = (
        F.when(f("rb"), F.when(~f("parsed"), 15).when(f("all"), 0).otherwise(25)).otherwise(0) + points(25, f("mp") & f("map"))
        + F.when(f("ll") & f("has_llms"), F.when(f("titled"), 15).otherwise(10)).otherwise(0) + F.when(f("api"), 15).when(f.yes("feed"), 10).otherwise(0)
        + F.when(~f("wk"), 0).when(f("mcp"), 20).when(f("mcp_any"), 5).when(f.yes("other"), 8).otherwise(0)
    )
    most = points(25, f("rb")) + points(25, f("mp")) + points(15, f("ll")) + 15 + points(20, f("wk"))
    return {"got": got, "most": most}


def discovery_outcome(f: Facts) -> Outcome:
    wk, ll, rb, mp, feed, other, blocked = f("wk"), f("ll"), f("rb"), f("mp"), f.yes("feed"), f.yes("other"), f.n("n_blocked")
    unseen = F.array_join(F.array_compact(F.array(*[F.when(~c, name) for c, name in ((rb, "robots"), (mp, "sitemap"), (ll, "llms"), (wk, "well-known"))])), ", ")
    confidence = F.when(f("most") == 100, "high").when(f("most") >= 60, "medium").otherwise("low")
    return Outcome(F.lit(True), round_half_up(100.0 * f("got") / f("most")), confidence, [
        finding(rb & f("all"), "discovery.robots.blocks-all", "critical"),
        finding(rb & f("open") & (blocked > 0), "discovery.robots.blocks-ai-agents", F.when(blocked >= MANY_BLOCKED, "high").otherwise("medium"), n=blocked),
        finding(rb & f("open") & (blocked == 0), "discovery.robots.present", "info", True),
        finding(rb & ~f("parsed"), "discovery.robots.missing", "low"),
        finding(mp & f("map"), "discovery.sitemap.present", "info", True),
        finding(mp & ~f("map"), "discovery.sitemap.missing", "medium"),
        finding(ll & f("has_llms"), "discovery.llms.present", "info", True, ~f("titled")),
        finding(ll & ~f("has_llms"), "discovery.llms.missing", "low"),
        finding(f("api"), "discovery.openapi.present", "info", True, evidence=f.paths("api_paths")),
        finding(~f("api") & feed, "discovery.feed.present", "info", True, evidence=f.paths("feed_paths")),
        finding(~f("api") & ~feed, "discovery.machine-entry.missing", "low"),
        finding(wk & f("mcp"), "discovery.mcp.present", "info", True),
        finding(wk & ~f("mcp") & f("mcp_any"), "discovery.mcp.invalid", "medium"),
        finding(wk & ~f("mcp_any") & other, "discovery.wellknown.other", "info", True),
        finding(wk & ~f("mcp_any") & ~other, "discovery.mcp.missing", "low"),
        finding(~(rb & mp & ll & wk), "discovery.unobserved", "info", False, False, which=unseen),
    ])


DISCOVERY = Rule("agent-discovery", discovery_facts, discovery_outcome, discovery_marks, discovery_evidence, (discovery_steps, discovery_points), sidecar_facts)


def check_discovery(pages: DataFrame, nodes: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Rows (page_id, applicable, score, confidence, findings) for ``pages`` (page_id, url) and ``sidecars``
    (page_id, key, path, ord, observed, status, body); a page without rows there observed nothing.

    What wasn't observed leaves the score's denominator; what answered with an error counts as absent.
    """
    return alone(Context(pages, nodes, sidecars), DISCOVERY)
