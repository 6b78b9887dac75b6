"""robots.txt as relations: lines to groups and rules, an index of rules by their literal beginnings, and the rule that decides a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.text import product_token, trim_space


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as an anchored regular expression: ``*`` is any run, a last ``$`` the end."""
    safe = F.regexp_replace(pattern, r"[.+?^${}()|\[\]\\]", r"\\$0")
    wild = F.replace(safe, F.lit("*"), F.lit(".*"))
    ended = F.when(F.endswith(wild, F.lit("\\$")), F.concat(F.regexp_replace(wild, r"\\\$\z", ""), F.lit("$"))).otherwise(wild)
    return F.concat(F.lit("^"), ended)


def parse_robots(bodies: DataFrame, key: str = "site", body: str = "body") -> DataFrame:
    """(site, group_no, kind, value, ord): agents and rules of each group, and sitemaps (of any group)."""
    raw = bodies.select(F.col(key).alias("site"), F.posexplode(F.split(F.col(body), r"\r?\n")).alias("ord", "raw"))
    line = trim_space(F.regexp_replace("raw", "#.*$", ""))
    keyed = raw.select("site", "ord", line.alias("line")).where(F.contains("line", F.lit(":")))
    keyed = keyed.select("site", "ord", F.lower(trim_space(F.split_part("line", F.lit(":"), F.lit(1)))).alias("kind"), trim_space(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    w = Window.partitionBy("site").orderBy("ord")
    starts = (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "user-agent")
    grouped = keyed.withColumn("starts", starts.cast("int")).withColumn("group_no", F.sum("starts").over(w))
    value = F.when(F.col("kind") == "user-agent", product_token(F.col("value"))).otherwise(F.col("value"))
    kept = grouped.where(F.col("kind").isin("user-agent", "sitemap") | (F.col("kind").isin("allow", "disallow") & (F.col("group_no") > 0)))
    return kept.select("site", "group_no", "kind", value.alias("value"), "ord")


def indexed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Robots texts as an index: a row a site (agents with their groups, lengths of literal beginnings, sitemaps), and a row for
    each site, group and literal beginning of patterns, with its rules in the order in which they win: longest first, then Allow."""
    rule = F.col("kind").isin("allow", "disallow") & (F.col("value") != "")
    literal = F.regexp_extract("value", r"^([^*]*?)(?:\*|\$\z|\z)", 1)
    p = parsed.withColumn("literal", F.when(rule, literal))
    sites = p.groupBy("site").agg(
        F.collect_set(F.when(F.col("kind") == "user-agent", F.struct(F.col("value").alias("agent"), "group_no"))).alias("agents"),
        F.collect_set(F.char_length("literal")).alias("lengths"), F.count_if((F.col("kind") == "sitemap") & (F.col("value") != "")).alias("sitemaps"),
    )
    wild = F.when(F.col("literal") != F.col("value"), pattern_regex(F.col("value")))
    ranked = F.struct(F.char_length("value").alias("n"), (F.col("kind") == "allow").alias("allow"), wild.alias("wild"))
    return sites, p.where(rule).groupBy("site", "group_no", "literal").agg(F.sort_array(F.collect_set(ranked), False).alias("rules"))


def verdicts(parsed: DataFrame, paths: DataFrame) -> DataFrame:
    """``paths`` (site, path, tokens, ...) with ``allowed``, an answer for each token in its order, and the site's ``sitemaps``; sites without a text allow all.

    A path's own beginnings, of the lengths that the site's patterns have, meet the patterns' literal beginnings by equality; only
    patterns with wildcards are tried as expressions after that. So a path makes a row for each such length, and one for each beginning it shares.
    """
    sites, rules = indexed(parsed)
    begun = paths.select("site", "path").distinct().join(sites.select("site", "lengths"), "site")
    own = F.filter("lengths", lambda n: n <= F.char_length("path"))
    begun = begun.select("site", "path", F.explode(F.transform(own, lambda n: F.left(F.col("path"), n))).alias("literal"))
    won = F.get(F.filter("rules", lambda r: r["wild"].isNull() | F.rlike(F.col("path"), r["wild"])), F.lit(0))
    hits = begun.join(rules, ["site", "literal"]).select("site", "path", "group_no", won.alias("rule")).where("rule is not null")
    hits = hits.groupBy("site", "path").agg(F.collect_list(F.struct(F.col("rule.n").alias("n"), F.col("rule.allow").alias("allow"), "group_no")).alias("hits"))
    x = paths.join(sites.drop("lengths"), "site", "left").join(hits, ["site", "path"], "left")
    answer = """transform(tokens, t -> coalesce(array_max(transform(filter(hits, h -> exists(agents, a -> a.group_no = h.group_no
        and a.agent = if(exists(agents, b -> b.agent = t), t, '*'))), h -> struct(h.n, h.allow))).allow, true))"""
    return x.select(*paths.columns, F.expr(answer).alias("allowed"), F.coalesce("sitemaps", F.lit(0)).alias("sitemaps"))


def robots_allowed(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """(site, token, path, allowed) for distinct asked rows: longest matching pattern wins, and Allow wins ties.

    A token's own groups decide, else those of ``*``; without groups or a matching rule, all is allowed.
    """
    q = asked.groupBy("site", "path").agg(F.collect_set("token").alias("asked")).withColumn("tokens", F.transform("asked", product_token))
    out = verdicts(parsed, q).select("site", "path", F.inline(F.arrays_zip("asked", "allowed")))
    return out.select("site", F.col("asked").alias("token"), "path", "allowed")
