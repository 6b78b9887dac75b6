"""What keeps a fetched answer from being audited, and notes on pages that aren't what they seem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.net import content_type_allowed, looks_like_html, origin, url_resolve
from auditlake.operators.rules import has

PAGE_TYPES = ["text/html", "application/xhtml+xml"]
CHALLENGE_CHARS, QUICK_REFRESH = 20_000, 5
# Words of challenges, and of pages that only block.
CHALLENGE_WORDS = ("captcha", "cf-challenge", "__cf_chl", "are you a human", "verify you are human", "attention required")
BLOCK_WORDS = ("access denied", "request blocked", "akamai", "perimeterx", "datadome", "imperva")
#: A report's title for each reason.
TITLES = {
    "invalid-url": "Not a public web address", "blocked-address": "Address not publicly reachable", "dns-failure": "Host not found", "too-many-redirects": "Too many redirects",
    "redirect-downgrade": "Redirect from https to http", "redirect-invalid": "Redirect to nowhere that can be followed", "timeout": "No answer in time", "network": "No connection",
    "content-type": "Not a page of HTML", "robots-disallow": "Site asks agents to stay away", "http-error": "Error in place of a page", "not-html": "Answer holds no HTML",
}


def challenge(headers: Column, body: Column) -> Column:
    """``header``, ``challenge`` or ``block-page`` where an answer is a bot check, else null; names of headers in lower case."""
    head = F.lower(F.left(body, F.lit(CHALLENGE_CHARS)))
    return (
        F.when(headers["cf-mitigated"] == "challenge", "header")
        .when(head.rlike("|".join(CHALLENGE_WORDS)), "challenge")
        .when(head.rlike("|".join(BLOCK_WORDS)) & (F.char_length(head) < CHALLENGE_CHARS), "block-page")
    )


def meta_refresh(pages: DataFrame) -> DataFrame:
    """(page_id, target) of every page (page_id, url, body): where its first quick refresh to its own origin leads, null if there is none."""
    tags = F.regexp_extract_all("body", F.lit(r"(?i)(<meta(?![A-Za-z0-9_])[^>]*>)"), 1)
    value = lambda tag, name: F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*{form}""", 1), F.lit("")) for form in ('"([^"]*)"', "'([^']*)'", r"""([^\s>"']+)""")])
    rows = pages.select("page_id", "url", F.posexplode_outer(tags).alias("pos", "tag")).where("pos is null or lower(tag) like '%refresh%' or pos = 0")
    content = F.when(F.lower(F.trim(value(F.col("tag"), "http-equiv"))) == "refresh", value(F.col("tag"), "content"))
    rows = rows.select("page_id", "url", "pos", content.alias("content"))
    delay = F.regexp_extract("content", r"^\s*(\d+(?:\.\d+)?)\s*;", 1).try_cast("double")
    to = F.regexp_replace(F.regexp_extract("content", r"(?is)^[^;]*;\s*url\s*=\s*(.*?)\s*\z", 1), r"^['\"]|['\"]$", "")
    rows = rows.withColumn("target", url_resolve(F.when(delay <= QUICK_REFRESH, to), F.col("url")))
    own = F.when(origin(F.col("target")) == origin(F.col("url")), F.col("pos"))
    return rows.groupBy("page_id").agg(F.min_by("target", own).alias("target"))


def frame_shells(nodes: DataFrame) -> DataFrame:
    """(page_id, frame_shell): framesets, and pages that are little but an inline frame."""
    tag = F.col("tag")
    words = F.max(F.when(tag == "#page", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))))
    thin = has(tag == "iframe") & (F.coalesce(words, F.lit(0)) < 30) & ~has(tag == "form") & ~has(tag == "main")
    return nodes.groupBy("page_id").agg((has(tag == "frameset") | thin).alias("frame_shell"))


def block_code(failure: Column, allowed: Column, content_type: Column, status: Column, body: Column) -> Column:
    """Why an answer isn't audited, the first reason in the order of a fetch; null where it is."""
    return (
        F.when(~F.coalesce(allowed, F.lit(True)), "robots-disallow")
        .when(failure.isNotNull(), failure)
        .when(~content_type_allowed(content_type, PAGE_TYPES), "content-type")
        .when(F.coalesce(status >= 400, F.lit(True)), "http-error")
        .when(~F.coalesce(looks_like_html(body), F.lit(False)), "not-html")
    )


def blocked_reports(answers: DataFrame) -> DataFrame:
    """(page_id, code, title, challenge) of the ``answers`` (page_id, failure, allowed, content_type, status, headers, body) that are blocked."""
    titles = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    code = block_code(*[F.col(c) for c in ("failure", "allowed", "content_type", "status", "body")])
    b = answers.select("page_id", code.alias("code"), challenge(F.col("headers"), F.col("body")).alias("challenge")).where("code is not null")
    return b.select("page_id", "code", titles[F.col("code")].alias("title"), F.when(F.col("code") == "http-error", F.col("challenge")).alias("challenge"))
