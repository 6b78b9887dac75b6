"""Operator 11: filter interaction audit: what each filter of a chain removes, alone, after others, and on average over all orders.

Each document becomes a mask of the filters it fails, and documents become counts by part and mask. The masks are then
unpivoted against all orders and steps: a window over the steps before gives the bits that an earlier filter has
already failed, conditional sums over the counts give what each step keeps, removes and removes for nothing, and a
window over a filter's rows its Shapley total. Only the counts meet the orders, so documents are never multiplied.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import read_table, stored

SPACES = r"[\x20\x09-\x0D]+"
REPEAT = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text alone (not null)."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeat: str | None = REPEAT, key: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, and how many of them are labelled so.

    ``filters``: failure conditions by letter, over a row with a column ``text`` (null counts as empty); the n-th letter is bit n of
    the mask. ``repeat``: the letter, last, of the filter that a text fails which a smaller key has too, anywhere in the table; rows
    without key neither fail it nor count as smaller, and neither do rows of the smallest key. A null part is the empty string. Rows
    that repeat count each. A key counts as good or toxic if any of its labels says so; labels without a key say nothing.

    A text's rows are first counted by part, labels and key, so that copies, however many, are few rows where they meet.
    """
    letters = filters or text_filters(F.col("text"))
    rows = docs.select(docs[key].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("text"))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(letters.values())), F.lit(0))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), mask.alias("mask"))
    rows = rows.groupBy("same", "mask", "part", "id").agg(F.count("*").alias("n"))
    said = labels.where(labels[key].isNotNull()).groupBy(labels[key].alias("id"))
    said = said.agg(F.max(F.when(labels["quality"] == 1, 1).otherwise(0)).alias("good"), F.max(F.when(labels["toxic"] == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(said, "id", "left").select("*", *(F.coalesce(F.col(c), F.lit(0)).alias(f"is_{c}") for c in ("good", "toxic")))
    if repeat is None:
        found = rows.select("part", "mask", "n", "is_good", "is_toxic")
    else:
        first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
        unnamed = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
        groups = stored(rows.groupBy("same", "mask", "part", "is_good", "is_toxic").agg(F.sum("n").alias("n"), unnamed, first))
        least = stored(groups.groupBy("same").agg(F.min("first.id").alias("least"), F.sum("n").alias("all")).where("all > 1").select("same", "least"))
        spared = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
        fails = F.when(F.col("least").isNull(), 0).otherwise(F.col("n") - spared)
        groups = groups.join(least, "same", "left").select("part", "mask", "is_good", "is_toxic", "n", fails.alias("fails"))
        kinds = F.array(
            F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("fails")).alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(letters))).alias("mask"), F.col("fails").alias("n")),
        )
        found = groups.select("part", "is_good", "is_toxic", F.inline(kinds)).where("n > 0")
    counts = [F.sum(F.col("n") * F.col(f"is_{c}")).alias(c) for c in ("good", "toxic")]
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), *counts)


def order_metrics(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of ``letters`` and step (from 1), zeros included; see the module's docstring for the columns.

    ``cells``: (part, mask, n, good, toxic), the n-th letter being bit n. No cells give no rows. Masks and orders, at most
    2**k * k! * k rows for k letters and so bounded whatever the input, are broadcast; k is six at most.
    """
    if not 1 <= len(letters) <= 6 or len(set(letters)) != len(letters):
        raise ValueError("one to six different letters")
    orders = F.explode(F.array(*(F.lit("".join(o)) for o in permutations(letters)))).alias("filter_order")
    step = F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    long = cells.select("mask").distinct().select("mask", orders).select("mask", "filter_order", step)
    long = long.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))).withColumn("bit", F.expr(f"shiftleft(1, locate(filter, '{letters}') - 1)"))
    long = long.withColumn("own", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    hit, first = F.col("own") != 0, F.col("earlier") == 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    out = cells.join(F.broadcast(long), "mask").groupBy("part", "filter_order", "step", "filter").agg(
        total(~hit & first).alias("kept"), total(hit & first).alias("removed"), total(hit & ~first).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(hit & first, "good").alias("good_lost"), total(hit & first, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over ``documents``, for each source (see ``failure_cells`` for nulls, repeats and ties)."""
    cells = stored(failure_cells(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))
    return order_metrics(cells, "ABCDE")


OP11_SQL = r"""
WITH said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
split AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
failing AS (SELECT s.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 50 AS a,
    100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(s.doc_id > min(s.doc_id) OVER (PARTITION BY t), false) AS e
    FROM split s LEFT JOIN said USING (doc_id)),
cells AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS past
    FROM orders, (SELECT unnest(range(1, 6)) AS step)),
long AS (SELECT *, contains(fails, f) AS hit, length(regexp_replace(fails, '[' || past || '_]', '', 'g')) < length(fails) AS gone FROM cells, steps),
sums AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM long GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM sums
"""
