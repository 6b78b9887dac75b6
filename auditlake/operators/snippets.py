"""Markup and scripts to paste, written from the element table: controls with their labels and options, corrected forms, tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import escape_attr, trim_space
from auditlake.operators import tools
from auditlake.operators.checks import FILL_RULES, expected_fill, expected_type, hint
from auditlake.operators.elements import attr, filled

FILLS = sorted({t for _, tokens in FILL_RULES for t in tokens} | {"on"})
#: What to put in place of an element that stands in for a control, by kind.
STAND_INS = {
    "actions.soup.handlers": '<button type="button">…</button>', "actions.soup.dead-links": '<a href="/target">…</a>',
    "actions.soup.role-only": '<button type="button">…</button>', "actions.soup.focusable": '<button type="button">…</button>',
}


def quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), value, F.lit('"'))


def option_lists(nodes: DataFrame) -> DataFrame:
    """(page_id, select, options): each select's options as markup, in document order.

    An option lies in the last select that begins before it, if it hasn't ended there; one window over a page's selects and options,
    so no option is paired with every select.
    """
    rows = nodes.where("tag in ('select', 'option')").withColumn("text", F.coalesce("text", F.lit("")))
    last = F.last(F.when(F.col("tag") == "select", F.struct("pre", "last")), True).over(Window.partitionBy("page_id").orderBy("pre"))
    rows = rows.withColumn("s", last).where("tag = 'option' and pre <= s.last")
    chosen = F.when(attr("selected").isNotNull(), " selected").otherwise("")
    line = F.concat(F.lit("  <option"), quoted("value", escape_attr(F.coalesce(attr("value"), F.col("text")))), chosen, F.lit(">"), escape_attr(F.col("text")), F.lit("</option>"))
    got = rows.groupBy("page_id", F.col("s.pre").alias("select")).agg(F.array_sort(F.collect_list(F.struct("pre", line.alias("line")))).alias("o"))
    return got.select("page_id", "select", F.array_join("o.line", "\n").alias("options"))


def form_snippets(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, markup): every control written anew with a label, a name, the type its names suggest and what fills it in.

    Texts are cut to 60 characters and escaped; a control without id and name is called ``field``. Its label is the text of its
    label, its placeholder, its aria-label or its id, the first that isn't empty.
    """
    c = nodes.where(F.col("control").isNotNull()).join(option_lists(nodes).withColumnRenamed("select", "pre"), ["page_id", "pre"], "left")
    c = c.withColumn("hint", hint())
    raw = F.coalesce(attr("id"), attr("name"), F.lit("field"))
    given = F.lower(trim_space(attr("autocomplete")))
    fill = F.when(given.isin(*FILLS), given).otherwise(expected_fill(F.col("hint")))
    label = escape_attr(F.coalesce(F.nullif(F.col("control.label"), F.lit("")), filled(attr("placeholder")), filled(attr("aria-label")), raw))
    ident, name = quoted("id", escape_attr(raw)), quoted("name", escape_attr(F.coalesce(attr("name"), raw)))
    ends = F.concat(F.coalesce(quoted("autocomplete", fill), F.lit("")), F.when(attr("required").isNotNull(), " required").otherwise(""))
    kind = F.coalesce(F.when(F.col("tag") == "input", expected_type(F.col("hint"))), F.lower(F.coalesce(attr("type"), F.lit("text"))))
    written = (
        F.when(F.col("tag") == "textarea", F.concat(F.lit("<textarea"), ident, name, ends, F.lit(">"), escape_attr(F.coalesce("text", F.lit(""))), F.lit("</textarea>")))
        .when(F.col("tag") == "select", F.concat(F.lit("<select"), ident, name, ends, F.lit(">\n"), F.coalesce("options", F.lit("  <!-- options -->")), F.lit("\n</select>")))
        .otherwise(F.concat(F.lit("<input"), ident, name, quoted("type", escape_attr(kind)), ends, F.lit(">")))
    )
    markup = F.concat(F.lit('<label for="'), escape_attr(raw), F.lit('">'), label, F.lit("</label>\n"), written)
    return c.select("page_id", "pre", markup.alias("markup"), F.col("control.name").isNull().alias("unnamed"))


def audit_snippets(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, id, snippet) for findings that something can be pasted for: each page's first control, form or tool that is meant."""
    controls = form_snippets(nodes)
    first = lambda rows, *ids: rows.groupBy("page_id").agg(F.min_by("markup", "pre").alias("snippet")).select("page_id", F.explode(F.array(*map(F.lit, ids))).alias("id"), "snippet")
    typed = first(controls, "forms.type.generic", "forms.autocomplete.missing", "forms.autocomplete.off", "forms.name.missing")
    named = first(controls.where("unnamed"), "forms.label.missing", "forms.label.placeholder-only")
    fixed = first(tools.corrected_tags(nodes), "webmcp.declarative.incomplete").unionByName(first(tools.control_lines(nodes), "webmcp.declarative.params"))
    stubs = tools.tool_stubs(pages, nodes)
    made = stubs.select("page_id", F.lit("webmcp.stub.imperative").alias("id"), F.col("call").alias("snippet")).unionByName(stubs.where("form_markup is not null").select("page_id", F.lit("webmcp.none").alias("id"), F.col("form_markup").alias("snippet")))
    soup = pages.select("page_id", F.inline(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("snippet")) for k, v in STAND_INS.items()])))
    return typed.unionByName(named).unionByName(fixed).unionByName(made).unionByName(soup)
