"""Pages as a table of elements, and what relates elements to each other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.html import Element, read
from auditlake.functions.relations import EXCLUDED_TYPES, Related, related
from auditlake.functions.text import trim_space
from auditlake.sources.cuts import cut

CONTROL = "struct<label:string,name:string,owner:int,submits:boolean,said:string>"
FORM = "struct<index:int,heading:string,legend:string,submit:string,controls:int,searches:int,told:int,untold:int,nameless:int>"
LD = "struct<valid:boolean,known:boolean,types:array<string>>"
ROW = f"""pre int, last int, depth int, parent int, tag string, attrs map<string,string>, text string, form int, label int, alt_inside boolean, path string,
items int, before int, control {CONTROL}, form_facts {FORM}, ld {LD}"""
INT, TEXT, FLAG = pa.int32(), pa.string(), pa.bool_()
ARROW = [
    INT, INT, INT, INT, TEXT, pa.map_(TEXT, TEXT), TEXT, INT, INT, FLAG, TEXT, INT, INT,
    pa.struct({"label": TEXT, "name": TEXT, "owner": INT, "submits": FLAG, "said": TEXT}),
    pa.struct({"index": INT, "heading": TEXT, "legend": TEXT, "submit": TEXT} | dict.fromkeys(("controls", "searches", "told", "untold", "nameless"), INT)),
    pa.struct({"valid": FLAG, "known": FLAG, "types": pa.list_(TEXT)}),
]
FIELDS = [*Element._fields, *Related._fields]
PIECE = 20_000  # elements of one batch
#: Marks anywhere in a page's markup that its ``#page`` row names among its attributes.
MARKS = {"framework": ("__NEXT_DATA__", "window.__NUXT__")}


def shred(pages: DataFrame, key: str = "page_id", html: str = "html", kept: bool = True) -> DataFrame:
    """One row for each element: ``page_id``, the fields of ``Element`` and of ``Related``; and one, of tag ``#page``, with the body's text.

    Null and empty pages have that row alone, its text empty. A table in fewer partitions than cores is dealt out first. ``kept`` cuts the plan, for elements that are used more than once.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for r, page in enumerate(b.column("html").to_pylist()):
                found, body = read(page)
                rows += [(*e, *more) for e, more in zip(found, related(found))]
                marks = {name: "" for name, needles in MARKS.items() if page and any(n in page for n in needles)}
                rows.append((*Element(len(found), len(found), 0, None, "#page", marks, body, None, None, False), *Related()))
                at += [r] * (len(found) + 1)
                if len(rows) >= PIECE:
                    yield batch(b, at, rows)
                    at, rows = [], []
            yield batch(b, at, rows)

    def batch(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(FIELDS)
        columns[5] = [list(a.items()) for a in columns[5]]
        made = [pa.array(c, t) for c, t in zip(columns, ARROW)]
        return pa.RecordBatch.from_arrays([b.column("page_id").take(pa.array(at, pa.int64())), *made], ["page_id", *FIELDS])

    source = spread(pages.select(pages[key].alias("page_id"), pages[html].alias("html")))
    found = source.mapInArrow(run, f"page_id {kind}, {ROW}")
    return cut(found) if kept else found


def spread(pages: DataFrame) -> DataFrame:
    """Pages dealt to all cores where they lie in fewer partitions, as reading them takes far longer than moving them; large tables stay as they lie."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def attr(name: str) -> Column:
    return F.expr(f"attrs['{name}']")


def filled(c: Column) -> Column:
    """The value without white space around it, or null where nothing is left."""
    return F.nullif(trim_space(c), F.lit(""))


def heading_stats(nodes: DataFrame) -> DataFrame:
    """Per page with headings: headings, h1s, skips (a level more than one below the heading before; the first never)."""
    level = heading_level()
    facts = [F.count(level).alias("headings"), F.count_if(level == 1).alias("h1s"), F.count_if(level > F.col("before") + 1).alias("skips")]
    return nodes.groupBy("page_id").agg(*facts).where("headings > 0")


def heading_level() -> Column:
    return F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))


def list_stats(nodes: DataFrame) -> DataFrame:
    """Per page with lists or articles: max_li (most ``li`` right below one ``ul`` or ``ol``) and articles."""
    out = nodes.groupBy("page_id").agg(F.coalesce(F.max("items"), F.lit(0)).alias("max_li"), F.count_if(F.col("tag") == "article").alias("articles"))
    return out.where("max_li > 0 or articles > 0")


def samples(rows: DataFrame, most: int) -> DataFrame:
    """(page_id, paths): the paths of each page's first ``most`` rows (page_id, pre, path) in document order, as evidence."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))).where(F.col("n") <= most)
    return first.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pre", "path")))["path"].alias("paths"))


def controls(nodes: DataFrame) -> DataFrame:
    """Form controls, each with its label's text, accessible name, owning form and whether that form has a submit (see ``Related``)."""
    kind = F.lower(F.coalesce(attr("type"), F.lit("text")))
    c = nodes.where(F.col("control").isNotNull())
    facts = [F.col("control.label").alias("label_text"), F.col("control.name").alias("name"), F.col("control.owner").alias("owned_by"), F.col("control.submits").alias("submits")]
    return c.select("page_id", "pre", "tag", kind.alias("kind"), "attrs", *facts)
