"""Rules over the elements of a page: structure, forms, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import round_half_up, trim_space
from auditlake.operators.elements import attr, filled, heading_level
from auditlake.operators.rules import EVIDENCE, Context, Facts, Outcome, Rule, alone, finding, first_of, has, points

NAMELY = r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"  # a whole word, as ASCII has them
# What names suggest about a field, in order of precedence: its type, and the tokens of autocomplete that fit it.
TYPE_RULES = [
    (r"e-?mail", "email"), (r"phone|tel(?![A-Za-z0-9_])|mobile", "tel"), (r"url|website|homepage", "url"), (NAMELY.format("date") + "|dob|birth", "date"),
    (r"qty|quantity|amount|count", "number"), (r"password|passwd", "password"),
]
FILL_RULES = [
    (r"first.?name|given", ("given-name",)), (r"last.?name|surname|family", ("family-name",)), (NAMELY.format("name"), ("name",)), (r"e-?mail", ("email",)),
    (r"phone|tel(?![A-Za-z0-9_])|mobile", ("tel",)), (r"street|address", ("street-address",)), (r"zip|postal", ("postal-code",)), (r"city|town", ("address-level2",)),
    (r"country", ("country",)), (r"username|login", ("username",)), (r"password|passwd", ("current-password", "new-password")),
]
MAIN_ACTION = "sign ?up|get started|buy|add to cart|checkout|book|reserve|subscribe|download|contact|start"
NATIVE_TAGS = ["a", "button", "input", "select", "textarea", "summary", "form", "label"]
NATIVE_INPUTS = ["submit", "button", "reset", "image", "checkbox", "radio", "range", "file"]
ROLE_ONLY_TAGS = ["div", "span", "li", "p", "img", "svg", "i"]
ROLES = ["button", "link", "menuitem", "tab"]


# ---- structure ----------------------------------------------------------------------------------------------------


def jsonld_stats(nodes: DataFrame) -> DataFrame:
    """Per page with JSON-LD: blocks, valid, schema_org (blocks under its context) and types, distinct, first seen first."""
    return nodes.groupBy("page_id").agg(*[c.alias(n) for n, c in jsonld_facts().items()]).where("blocks > 0")


def jsonld_facts() -> dict[str, Column]:
    types = F.array_sort(F.collect_list(F.when(F.col("ld").isNotNull(), F.struct("pre", "ld.types"))))["types"]
    return {"blocks": F.count("ld"), "valid": F.count_if(F.col("ld.valid")), "schema_org": F.count_if(F.col("ld.known")), "types": F.array_distinct(F.flatten(types))}


def structure_marks() -> dict[str, Column]:
    return {"level": heading_level(), "role": attr("role")}


def structure_evidence(m: Facts) -> dict[str, tuple[Column, int]]:
    return {"ld_paths": (F.col("ld").isNotNull(), 3), "head_paths": ((m("level") == 1) | (m("level") > F.col("before") + 1), EVIDENCE)}


def structure_facts(m: Facts) -> dict[str, Column]:
    tag, role, rel, level = F.col("tag"), m("role"), F.lower(attr("rel")), m("level")
    meta = lambda key, name: first_of((tag == "meta") & (attr(key) == name), F.coalesce(attr("content"), F.lit("")))
    return jsonld_facts() | {
        "title": first_of(tag == "title", F.col("text")), "description": trim_space(meta("name", "description")),
        "og_title": meta("property", "og:title"), "og_description": meta("property", "og:description"),
        "main": has((tag == "main") | (role == "main")), "nav": has((tag == "nav") | (role == "navigation")),
        "ends": has(tag.isin("header", "footer") | role.isin("banner", "contentinfo")),
        "lang": first_of(tag == "html", attr("lang")), "canonical": first_of((tag == "link") & (rel == "canonical"), attr("href")),
        "headings": F.count(level), "h1s": F.count_if(level == 1), "skips": F.count_if(level > F.col("before") + 1),
    }


def structure_outcome(f: Facts) -> Outcome:
    given = lambda name: F.coalesce(f(name) != "", F.lit(False))
    count, true = f.n, f.yes
    typed = (count("schema_org") > 0) & (F.coalesce(F.size(f("types")), F.lit(0)) > 0)
    og = given("og_title").cast("int") + given("og_description").cast("int")
    whole = given("title") & given("description")
    outlined = (count("h1s") == 1) & (count("skips") == 0)
    score = (
        F.when(typed, 30).when(count("blocks") > 0, 10).otherwise(0) + F.when(whole, 10).when(given("title"), 5).otherwise(0) + 5 * og
        + points(10, true("main")) + points(5, true("nav")) + points(5, true("ends")) + F.when(count("h1s") == 1, 10).when(count("h1s") > 1, 5).otherwise(0)
        + F.when(count("headings") == 0, 0).when(count("skips") == 0, 10).otherwise(5) + points(5, given("lang")) + points(5, given("canonical"))
    )
    types = F.array_join(F.slice(f("types"), 1, 5), ", ")
    return Outcome(F.lit(True), score, F.lit("high"), [
        finding(typed, "structure.jsonld.present", "info", True, evidence=f.paths("ld_paths"), types=types),
        finding(~typed & (count("blocks") > 0), "structure.jsonld.invalid", "medium", evidence=f.paths("ld_paths"), n=count("blocks")),
        finding(count("blocks") == 0, "structure.jsonld.missing", "high"),
        finding(~whole, "structure.meta.incomplete", F.when(given("title"), "low").otherwise("medium"), missing=F.when(given("title"), "description").when(given("description"), "title").otherwise("title and description")),
        finding(og == 0, "structure.og.missing", "low"),
        finding(~true("main"), "structure.landmarks.no-main", "medium"),
        finding(true("main"), "structure.landmarks.present", "info", True),
        finding(~outlined, "structure.headings.hierarchy", F.when(count("h1s") == 0, "medium").otherwise("low"), evidence=f.paths("head_paths"), h1s=count("h1s"), skips=count("skips")),
        finding(outlined, "structure.headings.ok", "info", True, n=count("headings")),
        finding(~(given("lang") & given("canonical")), "structure.document.meta", "low", missing=F.when(given("lang"), "canonical link").when(given("canonical"), "lang").otherwise("lang and canonical link")),
    ])


STRUCTURE = Rule("machine-readable-structure", structure_facts, structure_outcome, structure_marks, structure_evidence)


def check_structure(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Structured data, description, landmarks, outline, language: every page applies, empty ones score 0."""
    return alone(Context(pages, nodes), STRUCTURE)


# ---- forms --------------------------------------------------------------------------------------------------------


def hint() -> Column:
    """What a control's names and label say, over its row of the element table."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (attr("name"), attr("id"), attr("autocomplete"), F.col("control.label"))])


def says(rule: str, of: Column) -> Column:
    return of.rlike(f"(?i){rule}")


def expected_type(of: Column) -> Column:
    """The type an input's names suggest; null if none."""
    return F.coalesce(*[F.when(says(rule, of), kind) for rule, kind in TYPE_RULES])


def expected_fill(of: Column) -> Column:
    """The first autocomplete token that a control's names suggest; null if none."""
    return F.coalesce(*[F.when(says(rule, of), tokens[0]) for rule, tokens in FILL_RULES])


def forms_marks() -> dict[str, Column]:
    c = F.col("control").isNotNull()
    return {"hint": F.when(c, hint()), "kind": F.when(c, F.lower(F.coalesce(attr("type"), F.lit("text")))), "fill": F.when(c, F.lower(F.coalesce(filled(attr("autocomplete")), F.lit("")))), "nameless": F.when(c, filled(attr("name")).isNull())}


def forms_marked(m: Facts) -> tuple[Column, ...]:
    """What facts and evidence share: fillable controls, controls that suggest a type, and whether they have it."""
    c = F.col("control").isNotNull()
    fills = c & says("|".join(f"(?:{rule})" for rule, _ in FILL_RULES), m("hint"))
    expected = F.when(F.col("tag") == "input", expected_type(m("hint")))
    typed = c & F.coalesce(expected.isNotNull(), F.lit(False))
    return c, fills, typed, typed & (expected == m("kind"))


def forms_facts(m: Facts) -> dict[str, Column]:
    n, (c, fills, typed, typed_ok) = F.count_if, forms_marked(m)
    named = F.col("control.name").isNotNull()
    return {
        "n": n(c), "named": n(c & named), "only_placeholder": n(c & ~named & filled(attr("placeholder")).isNotNull()), "with_name": n(c & ~m("nameless")),
        "typed": n(typed), "typed_ok": n(typed_ok), "fills": n(fills), "unfilled": n(fills & (m("fill") == "")), "off": n(fills & (m("fill") == "off")),
        "submits": n(c & F.col("control.submits")), "orphans": n(c & F.col("control.owner").isNull()), "required": n(c & attr("required").isNotNull()),
        "tool": has((F.col("tag") == "form") & attr("toolname").isNotNull()),
    }


def forms_evidence(m: Facts) -> dict[str, tuple[Column, int]]:
    c, fills, typed, typed_ok = forms_marked(m)
    return {
        "unnamed_paths": (c & F.col("control.name").isNull(), EVIDENCE), "nameless_paths": (c & m("nameless"), EVIDENCE), "generic_paths": (typed & ~typed_ok, EVIDENCE),
        "unfilled_paths": (fills & (m("fill") == ""), EVIDENCE), "off_paths": (fills & (m("fill") == "off"), EVIDENCE), "orphan_paths": (c & F.col("control.owner").isNull(), EVIDENCE),
        "stuck_paths": (c & ~F.col("control.submits"), EVIDENCE), "tool_paths": ((F.col("tag") == "form") & attr("toolname").isNotNull(), 3),
    }


def forms_outcome(f: Facts) -> Outcome:
    some = f.n("n") > 0
    share = lambda part, of: F.try_divide(part.cast("double"), of)
    n, fits = f.n("n"), f.n("fills") - f.n("unfilled") - f.n("off")
    total = (
        40 * share(f("named"), n) + 15 * share(f("with_name"), n) + 20 * F.coalesce(share(f("typed_ok"), f("typed")), F.lit(1.0))
        + 15 * F.coalesce(share(fits, f("fills")), F.lit(1.0)) + 10 * share(f("submits"), n)
    )
    return Outcome(some, F.when(some, round_half_up(total)), F.lit("high"), [
        finding(~some, "forms.none", "info", False, False),
        finding(f.n("only_placeholder") > 0, "forms.label.placeholder-only", "medium", evidence=f.paths("unnamed_paths"), n=f.n("only_placeholder")),
        finding(some & (f("named") < n), "forms.label.missing", "high", evidence=f.paths("unnamed_paths"), n=n - f("named"), of=n),
        finding(some & (f("named") == n), "forms.label.ok", "info", True, n=n),
        finding(some & (f("with_name") < n), "forms.name.missing", "medium", evidence=f.paths("nameless_paths"), n=n - f("with_name")),
        finding(f.n("typed_ok") < f.n("typed"), "forms.type.generic", "medium", evidence=f.paths("generic_paths"), n=f("typed") - f("typed_ok")),
        finding((f.n("typed") > 0) & (f("typed_ok") == f("typed")), "forms.type.ok", "info", True, n=f("typed")),
        finding(f.n("unfilled") > 0, "forms.autocomplete.missing", "low", evidence=f.paths("unfilled_paths"), n=f("unfilled")),
        finding(f.n("off") > 0, "forms.autocomplete.off", "low", evidence=f.paths("off_paths"), n=f("off")),
        finding((f.n("fills") > 0) & (fits == f("fills")), "forms.autocomplete.ok", "info", True, n=f("fills")),
        finding(f.n("orphans") > 0, "forms.no-form-element", "high", evidence=f.paths("orphan_paths"), n=f("orphans")),
        finding(some & (f("submits") < n), "forms.submit.missing", "medium", evidence=f.paths("stuck_paths"), n=n - f("submits")),
        finding(some & (f("submits") == n), "forms.submit.ok", "info", True, n=n),
        finding(some & f.yes("tool"), "forms.webmcp.declarative", "info", True, evidence=f.paths("tool_paths")),
        finding(f.n("required") > 0, "forms.required.ok", "info", True, n=f("required")),
    ])


FORMS = Rule("form-semantics", forms_facts, forms_outcome, forms_marks, forms_evidence)


def check_forms(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names, types, autocomplete and submit of the controls. Pages without controls don't apply and have no score."""
    return alone(Context(pages, nodes), FORMS)


# ---- actions ------------------------------------------------------------------------------------------------------


def soup_kind() -> Column:
    """How an element stands in for a native action, if it does; the first kind that fits."""
    tag, click, href = F.col("tag"), attr("onclick"), filled(attr("href"))
    role = F.lower(F.coalesce(attr("role"), F.lit("")))
    dead = href.isNull() | (href == "#") | href.rlike("(?i)^javascript:")
    bare = attr("href").isNull() & click.isNull() & (role == "") & (F.coalesce("text", F.lit("")) == "")
    return (
        F.when(click.isNotNull() & ~tag.isin(*NATIVE_TAGS), "handlers")
        .when(tag.isin(*ROLE_ONLY_TAGS) & role.isin(*ROLES), "role-only")
        .when((tag == "a") & bare, None)
        .when((tag == "a") & dead, "dead-links")
        .when(tag.isin("div", "span") & attr("tabindex").isNotNull() & (role == ""), "focusable")
    )


SOUP = {"handlers": None, "dead-links": "medium", "role-only": "low", "focusable": "low"}


def actions_marks() -> dict[str, Column]:
    tag, href = F.col("tag"), filled(attr("href"))
    usable = (tag == "a") & href.isNotNull() & (href != "#") & ~href.rlike("(?i)^javascript:")
    native = usable | tag.isin("button", "form", "select", "summary") | ((tag == "input") & F.lower(F.coalesce(attr("type"), F.lit(""))).isin(*NATIVE_INPUTS))
    soup, button = soup_kind(), (tag == "button") | (attr("role") == "button")
    named = (F.col("text") != "") | F.coalesce(*[filled(attr(a)) for a in ("aria-label", "aria-labelledby", "title")]).isNotNull() | F.col("alt_inside")
    acts = F.coalesce("text", F.lit("")).rlike(f"(?i){MAIN_ACTION}")
    return {
        "native": native, "soup": soup, "named": F.when(button, F.coalesce(named, F.lit(False))),
        "main": (tag == "form") | (tag.isin("a", "button") & native & acts), "main_soup": soup.isNotNull() & acts,
    }


def actions_facts(m: Facts) -> dict[str, Column]:
    return {
        "native": F.count_if(m("native")), "soup": F.count(m("soup")), **{k.replace("-", "_"): F.count_if(m("soup") == k) for k in SOUP}, "buttons": F.count(m("named")),
        "named": F.count_if(m("named")), "main_native": has(m("main")), "main_soup": has(m("main_soup")), "scripted": has((F.col("tag") == "script") & attr("src").isNotNull()),
    }


def actions_evidence(m: Facts) -> dict[str, tuple[Column, int]]:
    kinds = {f"{k.replace('-', '_')}_paths": (m("soup") == k, 3) for k in SOUP}
    return kinds | {"unnamed_paths": (~m("named"), EVIDENCE), "main_paths": (m("main"), 1), "main_soup_paths": (m("main_soup"), 1)}


def actions_outcome(f: Facts) -> Outcome:
    native, soup, main = f.n("native"), f.n("soup"), f.yes("main_native")
    some = native + soup > 0
    total = (
        round_half_up(F.try_divide(70.0 * native, native + soup))
        + F.when(f.n("buttons") == 0, 15).otherwise(round_half_up(F.try_divide(15.0 * f.n("named"), f.n("buttons"))))
        + points(15, main | ~f.yes("main_soup"))
    )
    severity = {k: v or F.when(f.n("handlers") >= 3, "high").otherwise("medium") for k, v in SOUP.items()}
    score = F.when(some, F.when(native == 0, 0).otherwise(total))
    return Outcome(some, score, F.when((soup > 0) | ~f.yes("scripted"), "high").otherwise("medium"), [
        finding(~some, "actions.none", "info", False, False),
        finding(some & (f("named") < f("buttons")), "actions.button.unnamed", "medium", evidence=f.paths("unnamed_paths"), n=f("buttons") - f("named")),
        finding(some & main, "actions.primary.native", "info", True, evidence=f.paths("main_paths")),
        finding(some & ~main & f.yes("main_soup"), "actions.primary.soup", "critical", evidence=f.paths("main_soup_paths")),
        *[finding(f.n(k.replace("-", "_")) > 0, f"actions.soup.{k}", v, evidence=f.paths(k.replace("-", "_") + "_paths"), n=f(k.replace("-", "_"))) for k, v in severity.items()],
        finding(some & (soup == 0), "actions.native.ok", "info", True, n=native),
    ])


ACTIONS = Rule("actionability", actions_facts, actions_outcome, actions_marks, actions_evidence)


def check_actions(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Native actions against their stand-ins. Pages with neither don't apply; without native ones the score is 0."""
    return alone(Context(pages, nodes), ACTIONS)
