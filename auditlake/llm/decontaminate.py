"""Operator 6: benchmark decontamination by winnowing, in DataFrame operations only.

Texts become hashes of k words; of every WINDOW_GRAMS hashes in a row the smallest is kept. Two texts that share SPAN
= k + WINDOW_GRAMS - 1 words in a row keep the same hash inside that span, so joining kept hashes finds every shared
span; each hit is then extended to the span around it and compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import durable, read_table

SPAN = 13
GRAM = 7
WINDOW_GRAMS = SPAN - GRAM + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints up to which a side is broadcast (16 bytes each, and a row's overhead); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in ``body``: a bound variable isn't inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none. ``lower`` serves ASCII texts, being faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(folded, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def grams(w: Column, k: int) -> Column:
    """Hashes of all k words in a row; the caller sees to it that there are k words."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.lit(k), F.slice(w, i, k)))


def least_of_windows(hashes: Column) -> Column:
    span = F.sequence(F.lit(1), F.size(hashes) - (WINDOW_GRAMS - 1))
    return F.transform(span, lambda i: F.array_min(F.slice(hashes, i, WINDOW_GRAMS)))


def no_longs() -> Column:
    return F.array().cast("array<long>")


def fingerprints(w: Column, short: list[int]) -> Column:
    """Kept hashes of a text: winnowed for spans, and all hashes of each length that a short item has."""
    kept = [F.when(F.size(w) >= SPAN, let(grams(w, GRAM), least_of_windows)).otherwise(no_longs())]
    kept += [F.when(F.size(w) >= k, grams(w, k)).otherwise(no_longs()) for k in short]
    return F.array_distinct(F.concat(*kept))


def places(w: Column, wanted: Column, short: list[int]) -> Column:
    """Where a text has wanted hashes, and the words around: (len, fp, at, left, ctx), ``at`` from 1."""

    def around(k: int, length: int) -> Column:
        def found(h: Column) -> Column:
            at = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_contains(wanted, F.element_at(h, i)))

            def one(i: Column) -> Column:
                left = F.least(i - 1, F.lit(length - k))
                return F.struct(
                    F.lit(length).alias("len"), F.element_at(h, i).alias("fp"), i.alias("at"), left.alias("left"),
                    F.slice(w, i - left, left + length).alias("ctx"),
                )

            return F.transform(at, one)

        empty = F.array().cast("array<struct<len:int,fp:bigint,at:int,left:int,ctx:array<string>>>")
        return F.when(F.size(w) >= length, let(grams(w, k), found)).otherwise(empty)

    return F.concat(around(GRAM, SPAN), *[around(k, k) for k in short])


def item_windows(items: DataFrame, short: list[int], key: str, text: str) -> DataFrame:
    """(item, win, len, fp, off): every window of every item, its kept hash and that hash's place in it from 0."""
    w = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where("item is not null")
    starts = F.sequence(F.lit(1), F.size("w") - (SPAN - 1))
    long = w.where(F.size("w") >= SPAN).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, SPAN))).alias("win"))
    hashed = long.select("item", "win", let(grams(F.col("win"), GRAM), lambda h: F.struct(F.array_min(h).alias("fp"), h.alias("h"))).alias("m"))
    # A hash that occurs twice in a window has several places; each is tried
    offs = F.filter(F.sequence(F.lit(0), F.lit(WINDOW_GRAMS - 1)), lambda i: F.element_at("m.h", i + 1) == F.col("m.fp"))
    spans = hashed.select("item", "win", F.lit(SPAN).alias("len"), F.col("m.fp").alias("fp"), F.explode(offs).alias("off"))
    for k in short:
        whole = w.where(F.size("w") == k).select("item", F.col("w").alias("win"), F.lit(k).alias("len"))
        spans = spans.unionByName(whole.select("*", F.xxhash64(F.lit(k), "win").alias("fp"), F.lit(0).alias("off")))
    return spans


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated, and the text's hash ``text_h``.

    A window is SPAN consecutive item words; an item of fewer, but not none, is one window. A word inside any
    occurrence of a window is hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no
    words and no hits; items without words or id are not looked for; an empty benchmark leaves all clean. Rows are
    told apart by key and text, so repeated keys, also null, each get their own result; other columns aren't read.
    Texts are read again only where a fingerprint met; both join sides are broadcast only below BROADCAST_ROWS.
    """
    d = docs.select(docs[key].alias("key"), docs[text].alias("text")).withColumn("text_h", F.xxhash64("text"))
    sizes = items.where(items[item_key].isNotNull()).select(F.size(words(items[item_text])).alias("n")).where(F.col("n").between(1, SPAN - 1))
    short = sorted(r["n"] for r in sizes.distinct().collect())  # 12 lengths at most
    windows = durable(item_windows(items, short, item_key, item_text))
    wanted = windows.select("fp").distinct()
    # Hashes are exploded on their own: a row of the join holds the key and one hash
    parts = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), fingerprints(w, short).alias("fps")))
    base = durable(d.select("key", "text_h", parts.alias("p")).select("key", "text_h", F.col("p.n").alias("n_words"), F.col("p.fps").alias("fps")))
    few = windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = base.select("key", "text_h", F.explode("fps").alias("fp")).join(F.broadcast(wanted) if few else wanted, "fp")
    met = durable(met.groupBy("key", "text_h").agg(F.collect_set("fp").alias("wanted")))
    small = (met.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_ROWS
    m = met.select(F.col("key").alias("mkey"), F.col("text_h").alias("mh"), "wanted")
    again = d.join(F.broadcast(m) if small else m, d["key"].eqNullSafe(m["mkey"]) & (d["text_h"] == m["mh"]))
    near = again.select("key", "text_h", F.explode(let(words(F.col("text")), lambda w: places(w, F.col("wanted"), short))).alias("x")).select("key", "text_h", "x.*")
    kinds = windows.select("win", "len", "fp", "off").distinct()
    kinds = F.broadcast(kinds) if few else kinds
    hit = near.join(kinds, ["fp", "len"]).where((F.col("off") <= F.col("left")) & (F.slice("ctx", F.col("left") - F.col("off") + 1, F.col("len")) == F.col("win")))
    hit = hit.select("key", "text_h", "win", (F.col("at") - F.col("off")).alias("s"), "len").distinct()
    hit = durable(hit)
    spans = hit.groupBy("key", "text_h").agg(F.collect_set(F.struct("s", "len")).alias("spans"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["len"] - 1)))))
    spans = spans.select("key", "text_h", n_hit.alias("n_hit"))
    of = windows.select("win", "item").distinct()
    named = hit.select("key", "text_h", "win").distinct().join(F.broadcast(of) if few else of, "win").select("key", "text_h", "item").distinct()
    named = named.groupBy("key", "text_h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = spans.join(named, spans["key"].eqNullSafe(named["key"]) & (spans["text_h"].eqNullSafe(named["text_h"])), "left")
    found = durable(found.select(spans["key"].alias("fkey"), spans["text_h"].alias("fh"), "n_hit", "items"))
    b = base.select("key", "text_h", "n_words")
    out = b.join(found, b["key"].eqNullSafe(found["fkey"]) & (b["text_h"] == found["fh"]), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_h",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that windows of ``benchmark`` hit, one row each (see ``decontaminate`` for nulls, empty texts and repeats)."""
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_h")


OP6_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
lengths AS (SELECT DISTINCT k FROM wins),
grams AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, lengths WHERE len(w) >= k)),
hits AS (SELECT g.doc_id, g.i, g.k, x.item FROM grams g JOIN wins x ON g.win = x.win AND g.k = x.k),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
  coalesce(hi.h, sha256('')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit_words hw ON d.doc_id = hw.doc_id LEFT JOIN hit_items hi ON d.doc_id = hi.doc_id
"""
