"""Tools that a page declares for agents, and what it would take to declare one from its first usable form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.net import origin
from auditlake.functions.text import collapse, escape_attr, json_string, schema_type, slug, trim_space
from auditlake.operators.elements import attr, filled
from auditlake.operators.rules import Context, Facts, Outcome, Rule, alone, finding, has, points

# How tools are registered, shimmed, named and switched off.
REGISTERS = r"(?<![A-Za-z0-9_])(?:document|navigator)\.modelContext\.registerTool\s*\("
REGISTERS_NOW = r"(?<![A-Za-z0-9_])document\.modelContext\.registerTool\s*\("
SHIM = r"webmcp-polyfill|@mcp-b/(?:webmcp-polyfill|global)"
TOOL_NAME = r"^[A-Za-z0-9_.-]{1,128}\z"
SWITCHED_OFF = r"^\s*tools\s*=\s*\(\s*\)\s*\z"
RESERVED_NAMES = ("__proto__", "constructor", "prototype")
NO_NAME, MOST_TOLD = "submit_form", 120
SHARE = 0.5


def webmcp_marks() -> dict[str, Column]:
    """Calls that register a tool, a form's state (valid, broken, null if it declares nothing), shims."""
    script = F.col("tag") == "script"
    name, about, form = filled(attr("toolname")), filled(attr("tooldescription")), F.col("form_facts")
    valid = F.coalesce(name.rlike(TOOL_NAME), F.lit(False)) & about.isNotNull() & (form["nameless"] == 0)
    return {
        "calls": script & attr("src").isNull() & F.coalesce(F.col("text").rlike(REGISTERS), F.lit(False)), "shim": script & F.coalesce(attr("src").rlike(f"(?i){SHIM}"), F.lit(False)),
        "valid": F.when(form.isNotNull() & (name.isNotNull() | about.isNotNull()), valid),
    }


def webmcp_facts(m: Facts) -> dict[str, Column]:
    form = F.col("form_facts")
    return {
        "calls": has(m("calls")), "schema": has(m("calls") & F.contains("text", F.lit("inputSchema"))), "modern": has(m("calls") & F.col("text").rlike(REGISTERS_NOW)), "shim": has(m("shim")),
        "trial_meta": has((F.col("tag") == "meta") & (F.lower(trim_space(attr("http-equiv"))) == "origin-trial")),
        "valid": F.count_if(m("valid")), "broken": F.count_if(~m("valid")), "told": F.sum(F.when(m("valid"), form["told"])), "untold": F.sum(F.when(m("valid"), form["untold"])),
    }


def webmcp_evidence(m: Facts) -> dict[str, tuple[Column, int]]:
    return {"call_paths": (m("calls"), 3), "valid_paths": (m("valid"), 3), "broken_paths": (~m("valid"), 3), "shim_paths": (m("shim"), 2)}


def webmcp_steps(f: Facts) -> dict[str, Column]:
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    header = lambda name: F.coalesce(headers[name], F.lit(""))
    return {
        "trial": f.yes("trial_meta") | F.map_contains_key(headers, "origin-trial"), "alone": trim_space(header("origin-agent-cluster")) == "?0",
        "off": F.exists(F.split(header("permissions-policy"), ","), lambda part: part.rlike(SWITCHED_OFF)),
    }


def webmcp_outcome(f: Facts) -> Outcome:
    told, valid, broken, calls = f.n("told"), f.n("valid"), f.n("broken"), f.yes("calls")
    enough = F.coalesce(F.try_divide(told.cast("double"), told + f.n("untold")) >= SHARE, F.lit(False))
    declared = F.when(valid > 0, F.lit(60) + points(10, enough)).when(broken > 0, 20).otherwise(0)
    called = F.when(calls, F.lit(25) + points(5, f.yes("schema"))).otherwise(0)
    total = F.least(F.lit(90), declared + called) + points(5, f.yes("shim")) + points(5, f("trial"))
    none = (valid == 0) & ~calls & (broken == 0) & ~f("off")
    score = F.when(f("off"), 0).when(f("alone"), F.least(total, F.lit(20))).otherwise(total)
    return Outcome(F.lit(True), score, F.when((valid > 0) | f("off"), "high").otherwise("medium"), [
        finding(valid > 0, "webmcp.declarative.present", "info", True, evidence=f.paths("valid_paths"), n=valid),
        finding(f.n("untold") > 0, "webmcp.declarative.params", "low", evidence=f.paths("valid_paths"), n=f.n("untold")),
        finding(broken > 0, "webmcp.declarative.incomplete", "medium", evidence=f.paths("broken_paths"), n=broken),
        finding(calls, "webmcp.imperative.referenced", "info", True, evidence=f.paths("call_paths")),
        finding(calls & ~f.yes("modern"), "webmcp.imperative.legacy", "low", evidence=f.paths("call_paths")),
        finding(f.yes("shim"), "webmcp.polyfill.present", "info", True, evidence=f.paths("shim_paths")),
        finding(f("trial"), "webmcp.origin-trial.present", "info", True),
        finding(f("off"), "webmcp.policy.disabled", "high"),
        finding(f("alone"), "webmcp.origin-cluster.off", "medium"),
        finding(none, "webmcp.none", "high"),
        finding(none, "webmcp.stub.imperative", "info", False, True),
    ])


WEBMCP = Rule("webmcp-capability", webmcp_facts, webmcp_outcome, webmcp_marks, webmcp_evidence, (webmcp_steps,))


def check_webmcp(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (page_id, applicable, score, confidence, findings) for ``pages`` (page_id, headers: map, names in lower case); every page applies."""
    return alone(Context(pages, nodes), WEBMCP)


def tool_forms(nodes: DataFrame) -> DataFrame:
    """The form of each page to declare as a tool: page_id, form (its place), form_index (among all forms), n_controls, and its
    ``facts``, ``attrs`` and ``path``.

    The first form with a control that isn't a lone search box, else the first with one. Pages without such a form give no row.
    """
    f = nodes.where(F.col("form_facts.controls") > 0)
    order = F.struct(((F.col("form_facts.controls") == 1) & (F.col("form_facts.searches") == 1)).alias("search_only"), "pre")
    got = f.groupBy("page_id").agg(F.min_by(F.struct("pre", F.col("form_facts").alias("facts"), "attrs", "path"), order).alias("x"))
    return got.select("page_id", F.col("x.pre").alias("form"), F.col("x.facts.index").alias("form_index"), F.col("x.facts.controls").alias("n_controls"), "x.facts", "x.attrs", "x.path")


def tool_params(nodes: DataFrame) -> DataFrame:
    """Parameters of each page's tool form: page_id, ord, name, type, description, required, and the control's tag, kind and id.

    Controls without a name, files and reserved names are left out; of a repeated name the first in document order
    stays. The description is the text of the label that names the control, of the one around it, its aria-label or placeholder, the
    first that isn't empty, cut to MOST_TOLD characters, else its name.
    """
    forms = tool_forms(nodes).select("page_id", F.col("form").alias("f"))
    c = nodes.where(F.col("control").isNotNull()).join(forms, "page_id").where("form = f").withColumn("name", filled(attr("name")))
    kind = F.lower(F.coalesce(attr("type"), F.lit("text")))
    c = c.where(F.col("name").isNotNull() & ~F.col("name").isin(*RESERVED_NAMES) & ~((F.col("tag") == "input") & (kind == "file")))
    about = F.coalesce(F.nullif(F.left("control.said", F.lit(MOST_TOLD)), F.lit("")), F.col("name"))
    c = c.select("page_id", "pre", "name", schema_type(F.col("tag"), kind).alias("type"), about.alias("description"), attr("required").isNotNull().alias("required"), "tag", kind.alias("kind"), attr("id").alias("id"))
    c = c.withColumn("again", F.row_number().over(Window.partitionBy("page_id", "name").orderBy("pre"))).where("again = 1")
    ord_ = F.row_number().over(Window.partitionBy("page_id").orderBy("pre")) - 1
    return c.select("page_id", ord_.alias("ord"), "name", "type", "description", "required", "tag", "kind", "id")


def input_schemas(params: DataFrame) -> DataFrame:
    """(page_id, schema): a JSON schema text of each page's parameters, in their order; ``required`` only where any is."""
    one = F.concat(json_string(F.col("name")), F.lit(':{"type":"'), "type", F.lit('","description":'), json_string(F.col("description")), F.lit("}"))
    rows = F.array_sort(F.collect_list(F.struct("ord", one.alias("text"), json_string(F.col("name")).alias("name"), "required")))
    g = params.groupBy("page_id").agg(rows.alias("rows"))
    needed = F.array_join(F.transform(F.filter("rows", lambda r: r["required"]), lambda r: r["name"]), ",")
    props = F.concat(F.lit('{"type":"object","properties":{'), F.array_join(F.transform("rows", lambda r: r["text"]), ","), F.lit("}"))
    tail = F.when(needed == "", F.lit("}")).otherwise(F.concat(F.lit(',"required":['), needed, F.lit("]}")))
    return g.select("page_id", F.concat(props, tail).alias("schema"))


def derived_names(facts: Column, attrs: Column) -> tuple[Column, Column]:
    """(tool name, description) that a form's own parts give: id, name, submit text, heading before it; legend, heading, submit text."""
    given = lambda name: filled(attrs[name])
    some = lambda name: F.nullif(facts[name], F.lit(""))
    name = F.coalesce(F.nullif(slug(F.coalesce(given("id"), given("name"), some("submit"), some("heading"), F.lit(""))), F.lit("")), F.lit(NO_NAME))
    about = F.nullif(F.left(collapse(F.coalesce(some("legend"), some("heading"), some("submit"), F.lit(""))), F.lit(MOST_TOLD)), F.lit(""))
    return name, F.coalesce(about, F.concat(F.lit("Submit the "), name, F.lit(" form")))


def opening_tag(attrs: Column, name: Column, about: Column) -> Column:
    """A form's start tag with both attributes of a tool; its other attributes stay if their names are plain."""
    kept = F.filter(F.map_entries(attrs), lambda e: e["key"].rlike(r"^[a-zA-Z_:][-a-zA-Z0-9_:.]*\z") & ~e["key"].isin("toolname", "tooldescription"))
    written = F.transform(kept, lambda e: F.when(e["value"] == "", F.concat(F.lit(" "), e["key"])).otherwise(F.concat(F.lit(" "), e["key"], F.lit('="'), escape_attr(e["value"]), F.lit('"'))))
    return F.concat(F.lit("<form"), F.array_join(written, ""), F.lit(' toolname="'), name, F.lit('" tooldescription="'), escape_attr(about, MOST_TOLD), F.lit('">'))


def corrected_tags(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, markup): the start tag of every form that declares only part of a tool, with both parts.

    A valid name stays; another becomes a slug, or is made up as a form's without one is.
    """
    name, about = filled(attr("toolname")), filled(attr("tooldescription"))
    own, told = derived_names(F.col("form_facts"), F.col("attrs"))
    forms = nodes.where(F.col("form_facts").isNotNull() & (name.isNotNull() | about.isNotNull()))
    to = F.when(F.coalesce(name.rlike(TOOL_NAME), F.lit(False)), name).otherwise(F.coalesce(F.nullif(slug(name), F.lit("")), own))
    return forms.select("page_id", "pre", opening_tag(F.col("attrs"), to, F.coalesce(F.left(about, F.lit(MOST_TOLD)), told)).alias("markup"))


def control_line(tag: Column, kind: Column, id_: Column, name: Column, about: Column) -> Column:
    """A control's tag with its name (whole, escaped) and what a tool says of it."""
    ident = F.when(F.coalesce(id_ != "", F.lit(False)), F.concat(F.lit(' id="'), escape_attr(id_), F.lit('"'))).otherwise("")
    named = F.concat(F.lit(' name="'), escape_attr(name, None), F.lit('"'))
    said = F.concat(F.lit(' toolparamdescription="'), escape_attr(about, MOST_TOLD), F.lit('"'))
    return (
        F.when(tag == "textarea", F.concat(F.lit("<textarea"), ident, named, said, F.lit("></textarea>")))
        .when(tag == "select", F.concat(F.lit("<select"), ident, named, said, F.lit(">…</select>")))
        .otherwise(F.concat(F.lit("<input"), ident, named, F.lit(' type="'), escape_attr(kind, 20), F.lit('"'), said, F.lit(">")))
    )


def control_lines(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, markup): every control of a form that lacks a description for tools, with one.

    A control without a name gets one from its id or label, else ``field``.
    """
    c = nodes.where(F.col("control").isNotNull() & F.col("form").isNotNull() & filled(attr("toolparamdescription")).isNull())
    some = lambda x: F.nullif(x, F.lit(""))
    name = F.coalesce(filled(attr("name")), some(slug(attr("id"))), some(slug(F.col("control.said"))), F.lit("field"))
    about = F.coalesce(some(F.left("control.said", F.lit(MOST_TOLD))), name)
    return c.select("page_id", "pre", control_line(F.col("tag"), F.lower(F.coalesce(attr("type"), F.lit("text"))), attr("id"), name, about).alias("markup"))


def tool_stubs(pages: DataFrame, nodes: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, tool_name, description, schema, call, form_markup): a tool for each page, from its form, else a site search of its own.

    The name comes from the form's id, name, submit or the heading before it, the description from its legend, heading or submit. ``call``
    registers the tool by script and fills in and submits the form; ``form_markup`` declares it in HTML, null for a search. Page text
    enters through ``json_string``, ``slug`` and ``escape_attr`` only.
    """
    f = tool_forms(nodes)
    name, about = derived_names(F.col("facts"), F.col("attrs"))
    params = tool_params(nodes)
    line = F.concat(F.lit("  "), control_line(F.col("tag"), F.col("kind"), F.col("id"), F.col("name"), F.col("description")))
    lines = params.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))["line"], "\n").alias("lines"))
    f = f.join(input_schemas(params), "page_id", "left").join(lines, "page_id", "left")
    f = f.select("page_id", name.alias("tool_name"), about.alias("description"), "schema", "attrs", "lines", F.col("form_index").alias("n"))
    search = '{"type":"object","properties":{"q":{"type":"string","description":"Search terms"}},"required":["q"]}'
    nothing = '{"type":"object","properties":{}}'
    p = pages.select("page_id", *([F.col(url).alias("url")] if url in pages.columns else [F.lit(None).cast("string").alias("url")]))
    site = F.nullif(origin(F.col("url")), F.lit("://"))
    made = p.join(f, "page_id", "left").select(
        "page_id", F.coalesce("tool_name", F.lit("search_site")).alias("tool_name"), F.coalesce("schema", F.when(F.col("tool_name").isNull(), search), F.lit(nothing)).alias("schema"),
        F.coalesce("description", F.concat(F.lit("Search "), site), F.lit("Search this site")).alias("description"), "attrs", "lines", "n", F.coalesce(site, F.lit("")).alias("site"),
    )
    fill = F.concat(F.lit("const f=document.forms["), F.col("n").cast("string"), F.lit("];for(const [k,v] of Object.entries(input)){const c=f.elements.namedItem(k);if(c){if(c.type==='checkbox'){c.checked=Boolean(v)}else{c.value=String(v)}}}f.requestSubmit();return {submitted:true}"))
    seek = F.concat(F.lit("const u=new URL('/search',"), json_string(F.col("site")), F.lit("||location.href);u.searchParams.set('q',String(input.q));location.assign(u);return {url:String(u)}"))
    call = F.concat(
        F.lit("document.modelContext.registerTool({name:"), json_string(F.col("tool_name")), F.lit(",description:"), json_string(F.col("description")), F.lit(",inputSchema:"), "schema",
        F.lit(",async execute(input){"), F.when(F.col("n").isNotNull(), fill).otherwise(seek), F.lit("}})"),
    )
    markup = F.when(F.col("n").isNotNull(), F.concat(opening_tag(F.col("attrs"), F.col("tool_name"), F.col("description")), F.lit("\n"), F.coalesce("lines", F.lit("")), F.lit("\n</form>")))
    return made.select("page_id", "tool_name", "description", "schema", call.alias("call"), markup.alias("form_markup"))
