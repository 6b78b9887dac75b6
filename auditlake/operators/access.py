"""Can a client without a browser read the page: headers, challenges, dependence on scripts, pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.elements import attr
from auditlake.operators.rules import Context, Facts, Outcome, Rule, alone, any_of, finding, first_of, has, points

# Marks of challenges, of pages that need scripts, of mount points and of pagers.
CHALLENGE_SOURCE = "recaptcha|hcaptcha|turnstile|challenges\\.cloudflare\\.com"
CHALLENGE_MARK = "g-recaptcha|h-captcha|cf-turnstile"
NEEDS_SCRIPT = "enable javascript|requires javascript|javascript is (required|disabled)"
MOUNTS = ("root", "app", "__next", "__nuxt")
PAGER = "pagination|pager"
LONG_LIST, FEW_WORDS = 20, 50
BOT_HEADERS = ("x-datadome", "x-akamai-", "x-px")


def says(c: Column, rule: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){rule}"), F.lit(False))


def marked(rule: str) -> Column:
    return says(attr("class"), rule) | says(attr("id"), rule)


def access_marks() -> dict[str, Column]:
    """A challenge is a script or frame of a known source, or an element marked as one; mounts are numbered."""
    mount = F.coalesce(*[F.when(attr("id") == m, i + 1) for i, m in enumerate(MOUNTS)])
    return {
        "challenge": (F.col("tag").isin("script", "iframe") & says(attr("src"), CHALLENGE_SOURCE)) | marked(CHALLENGE_MARK),
        "noscript": (F.col("tag") == "noscript") & says(F.col("text"), NEEDS_SCRIPT), "mount": mount, "root": attr("data-reactroot").isNotNull(),
    }


def access_facts(m: Facts) -> dict[str, Column]:
    """A challenge stands on a form where it is the form or inside it; the first element of each mount point counts."""
    tag, src, href = F.col("tag"), attr("src"), attr("href")
    words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
    rel = F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"[ \t\n\f\r]+")
    mounts = [m("root"), *[m("mount") == i + 1 for i in range(len(MOUNTS))]]
    return {
        "challenge": has(m("challenge")), "on_form": has(m("challenge") & (F.col("form").isNotNull() | (tag == "form"))), "words": F.max(F.when(tag == "#page", words)),
        "scripted": has((tag == "script") & src.isNotNull()), **{f"mount{i}": first_of(mount, F.coalesce("text", F.lit(""))) for i, mount in enumerate(mounts)},
        "noscript": has(m("noscript")), "links": has(((tag == "a") & href.isNotNull()) | (tag == "form")), "framework": has((tag == "#page") & attr("framework").isNotNull()),
        "articles": F.count_if(tag == "article"), "max_li": F.max("items"),
        "paged": has((tag.isin("a", "link") & F.array_contains(rel, "next")) | ((tag == "a") & F.contains(href, F.lit("page="))) | marked(PAGER)),
    }


def access_evidence(m: Facts) -> dict[str, tuple[Column, int]]:
    return {
        "challenge_paths": (m("challenge"), 3), "script_paths": (m("noscript") | m("root") | F.coalesce(m("mount") > 0, F.lit(False)), 3),
        "list_paths": (F.coalesce(F.col("items") >= LONG_LIST, F.lit(False)), 1),
    }


def access_steps(f: Facts) -> dict[str, Column]:
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    robots = F.lower(F.coalesce(headers["x-robots-tag"], F.lit("")))
    noai = robots.rlike(r"(?<![a-z0-9_])(noai|noimageai)(?![a-z0-9_])")
    bots = F.filter(F.map_keys(headers), lambda k: (k == "cf-mitigated") | any_of([k.startswith(h) for h in BOT_HEADERS]))
    thin = (f.n("words") < FEW_WORDS) & f.yes("scripted")
    empty = any_of([F.coalesce(f(f"mount{i}") == "", F.lit(False)) for i in range(1 + len(MOUNTS))])
    fired = [thin, empty, f.yes("noscript"), ~f.yes("links"), thin & f.yes("framework")]
    long_list = (f.n("max_li") >= LONG_LIST) | (f.n("articles") >= LONG_LIST)
    return {
        "noai": noai, "noindex": ~noai & robots.rlike(r"(?<![a-z0-9_])(noindex|none)(?![a-z0-9_])"), "bots": bots,
        "js": sum((x.cast("int") for x in fired[1:]), fired[0].cast("int")), "unpaged": long_list & ~f.yes("paged"),
    }


def access_outcome(f: Facts) -> Outcome:
    js, bots, challenge, on_form = f("js"), F.size(f("bots")) > 0, f.yes("challenge"), f.yes("on_form")
    clear = ~f("noai") & ~f("noindex")
    total = (
        points(10, F.coalesce(F.col("status").between(200, 299), F.lit(False))) + points(10, clear) + points(10, ~bots)
        + F.when(~challenge, 20).when(on_form, 0).otherwise(10)
        + F.when(js == 0, 35).when(js == 1, 25).when(js == 2, 12).otherwise(0) + points(15, ~f("unpaged"))
    )
    score = F.when(js >= 3, F.least(total, F.lit(35))).when(js == 2, F.least(total, F.lit(60))).otherwise(total)
    return Outcome(F.lit(True), score, F.when(js >= 2, "low").when((js == 1) | bots, "medium").otherwise("high"), [
        finding(f("noai"), "access.headers.noai", "medium"),
        finding(f("noindex"), "access.headers.noindex", "medium"),
        finding(bots, "access.headers.bot-management", "low", headers=F.array_join(F.slice(f("bots"), 1, 3), ", ")),
        finding(clear & ~bots, "access.headers.ok", "info", True),
        finding(~challenge, "access.captcha.none", "info", True),
        finding(on_form, "access.captcha.on-form", "high", evidence=f.paths("challenge_paths")),
        finding(challenge & ~on_form, "access.captcha.present", "medium", evidence=f.paths("challenge_paths")),
        finding(js == 0, "access.js.static", "info", True, words=f.n("words")),
        finding(js == 1, "access.js.possible", "low", evidence=f.paths("script_paths"), n=js),
        finding(js == 2, "access.js.likely", "medium", evidence=f.paths("script_paths"), n=js),
        finding(js >= 3, "access.js.required", "high", evidence=f.paths("script_paths"), n=js),
        finding(f("unpaged"), "access.scroll.no-pagination", "medium", evidence=f.paths("list_paths"), n=F.greatest(f.n("max_li"), f.n("articles"))),
    ])


ACCESS = Rule("access-renderability", access_facts, access_outcome, access_marks, access_evidence, (access_steps,))


def check_access(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (page_id, applicable, score, confidence, findings) for ``pages`` (page_id, status, headers: map, names in lower case).

    Null headers are none, a null status is no success. Every page applies.
    """
    return alone(Context(pages, nodes), ACCESS)
