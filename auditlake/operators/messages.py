"""What findings and results say: a table of texts with slots and plural forms, joined to what checks found."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Message(NamedTuple):
    """``detail`` for one (or no count) and ``many`` for several; words in braces are a finding's slots. ``fix``: what to do about it."""

    id: str
    title: str
    detail: str
    many: str | None = None
    fix: str | None = None


MESSAGES = [
    Message("discovery.robots.blocks-all", "Robots rules shut every client out", "The rules for all clients forbid both the front page and this page.", None, "Allow the paths that agents may read in the group for all user agents."),
    Message("discovery.robots.blocks-ai-agents", "Robots rules turn AI agents away", "One well-known AI agent may not read this page.", "{n} well-known AI agents may not read this page.", "Give the agents you want as readers a group that allows the page."),
    Message("discovery.robots.present", "Robots rules let agents in", "A robots file was found and allows this page."),
    Message("discovery.robots.missing", "No robots file", "The site answered without usable robots rules.", None, "Publish a plain text file at /robots.txt."),
    Message("discovery.sitemap.present", "Sitemap found", "A sitemap was found, or the robots file names one."),
    Message("discovery.sitemap.missing", "No sitemap", "Neither a sitemap file nor a line for one in the robots file was found.", None, "Publish a sitemap and name it in the robots file."),
    Message("discovery.llms.present", "Summary for language models found", "The site offers an llms.txt file.", None, "Begin the file with a title line."),
    Message("discovery.llms.missing", "No summary for language models", "The site offers no llms.txt file.", None, "Describe the site and its main pages in /llms.txt."),
    Message("discovery.openapi.present", "Interface description found", "The page links to a machine-readable description of its interface."),
    Message("discovery.feed.present", "Feed found", "The page links to a feed."),
    Message("discovery.machine-entry.missing", "No entry for machines", "The page links to neither a feed nor an interface description.", None, "Link a feed or an OpenAPI document from the head of the page."),
    Message("discovery.mcp.present", "Protocol metadata found", "A well-known file describes a server or a protected resource."),
    Message("discovery.mcp.invalid", "Protocol metadata can't be used", "A well-known file is there but lacks what it must hold.", None, "Serve a JSON object with the fields that the file's standard asks for."),
    Message("discovery.wellknown.other", "Other well-known file found", "The site publishes another well-known JSON file."),
    Message("discovery.mcp.missing", "No protocol metadata", "No well-known file describes a server for agents.", None, "Publish a server card under /.well-known/ if the site runs one."),
    Message("discovery.unobserved", "Some signals weren't seen", "Not observed, and so not counted: {which}."),
    Message("structure.jsonld.present", "Linked data found", "Blocks of linked data name these types: {types}."),
    Message("structure.jsonld.invalid", "Linked data can't be used", "The page's block of linked data is no valid typed schema.org data.", "None of the page's {n} blocks of linked data is valid typed schema.org data.", "Use valid JSON with a schema.org context and a type."),
    Message("structure.jsonld.missing", "No linked data", "The page has no block of linked data.", None, "Add a JSON-LD script that says what the page is about."),
    Message("structure.meta.incomplete", "Page isn't described", "The page lacks: {missing}.", None, "Give the page a title and a meta description."),
    Message("structure.og.missing", "No preview data", "Neither a title nor a description for previews was found.", None, "Add og:title and og:description."),
    Message("structure.landmarks.no-main", "Main part isn't marked", "No element is marked as the page's main part.", None, "Wrap the main part in a main element."),
    Message("structure.landmarks.present", "Main part is marked", "The page has a main landmark."),
    Message("structure.headings.hierarchy", "Headings give no clear outline", "The page has {h1s} headings of the first level and {skips} skipped levels.", None, "Use one first-level heading and don't skip levels."),
    Message("structure.headings.ok", "Headings give an outline", "The page's heading stands in order.", "The page's {n} headings stand in order."),
    Message("structure.document.meta", "Language or address isn't declared", "The page lacks: {missing}.", None, "Declare the language on html and a canonical link in the head."),
    Message("access.headers.noai", "A header refuses AI use", "The answer's x-robots-tag asks AI systems to stay away.", None, "Drop the directive if agents are welcome."),
    Message("access.headers.noindex", "A header refuses indexing", "The answer's x-robots-tag asks not to be indexed.", None, "Drop the directive on pages that should be found."),
    Message("access.headers.bot-management", "Bot management stands in front", "These headers show a bot filter: {headers}.", None, "Let well-behaved agents pass the filter."),
    Message("access.headers.ok", "Headers are open", "No header refuses agents."),
    Message("access.captcha.none", "No challenge found", "The page carries no mark of a human check."),
    Message("access.captcha.on-form", "A human check guards a form", "A form holds a challenge that agents can't pass.", None, "Check submissions on the server, or only where they look abusive."),
    Message("access.captcha.present", "A human check is loaded", "The page loads a challenge outside of its forms.", None, "Load the challenge only where it is needed."),
    Message("access.js.static", "Readable without scripts", "The markup holds the content: {words} words."),
    Message("access.js.possible", "May need scripts", "One of five signs says that content comes by script.", None, "Send the content in the markup."),
    Message("access.js.likely", "Probably needs scripts", "{n} of five signs say that content comes by script.", "{n} of five signs say that content comes by script.", "Render the content on the server."),
    Message("access.js.required", "Needs scripts", "{n} of five signs say that there is no content without scripts.", "{n} of five signs say that there is no content without scripts.", "Render the page on the server, with links and forms in its markup."),
    Message("access.scroll.no-pagination", "Long list without pages", "A list of {n} entries links to no further page.", "A list of {n} entries links to no further page.", "Link to the next part by a plain link."),
    Message("forms.none", "No form controls", "The page holds nothing to fill in."),
    Message("forms.label.placeholder-only", "Named by a placeholder alone", "One control has a placeholder but no name.", "{n} controls have a placeholder but no name.", "Add a label; a placeholder goes once something is typed."),
    Message("forms.label.missing", "Controls without a name", "One of {of} controls has no accessible name.", "{n} of {of} controls have no accessible name.", "Tie a label to each control."),
    Message("forms.label.ok", "All controls are named", "The control has an accessible name.", "All {n} controls have accessible names."),
    Message("forms.name.missing", "Controls that aren't sent", "One control has no name attribute.", "{n} controls have no name attribute.", "Give each control a name, so that its value is sent."),
    Message("forms.type.generic", "Types say too little", "One input has another type than its name suggests.", "{n} inputs have other types than their names suggest.", "Use the type that fits, such as email, tel or date."),
    Message("forms.type.ok", "Types fit", "The typed input has the type its name suggests.", "All {n} typed inputs have the types their names suggest."),
    Message("forms.autocomplete.missing", "Autocomplete isn't declared", "One control could name what fills it in.", "{n} controls could name what fills them in.", "Add the autocomplete token that fits."),
    Message("forms.autocomplete.off", "Autocomplete is switched off", "One control refuses to be filled in.", "{n} controls refuse to be filled in.", "Replace off by the token that fits."),
    Message("forms.autocomplete.ok", "Autocomplete is declared", "The control that can be filled in says so.", "All {n} controls that can be filled in say so."),
    Message("forms.no-form-element", "Controls outside a form", "One control belongs to no form.", "{n} controls belong to no form.", "Put controls into a form, or name it by a form attribute."),
    Message("forms.submit.missing", "No way to submit", "One control's form has no submit button.", "{n} controls' forms have no submit button.", "Add a button of type submit."),
    Message("forms.submit.ok", "Forms can be submitted", "The control's form has a submit button.", "All {n} controls' forms have submit buttons."),
    Message("forms.webmcp.declarative", "A form is declared as a tool", "A form carries a tool name."),
    Message("forms.required.ok", "Required fields are marked", "One control is marked as required.", "{n} controls are marked as required."),
    Message("actions.none", "Nothing to act on", "The page has neither native actions nor stand-ins for them."),
    Message("actions.button.unnamed", "Buttons without a name", "One button says nothing about what it does.", "{n} buttons say nothing about what they do.", "Give each button text or an aria-label."),
    Message("actions.primary.native", "Main action is native", "The page's main action is a form, link or button."),
    Message("actions.primary.soup", "Main action is no real control", "The page's main action is an element that only scripts bring to life.", None, "Make it a button or a link."),
    Message("actions.soup.handlers", "Click handlers on plain elements", "One plain element reacts to clicks.", "{n} plain elements react to clicks.", "Use a button."),
    Message("actions.soup.dead-links", "Links that lead nowhere", "One link has no target.", "{n} links have no target.", "Give the link a target, or use a button."),
    Message("actions.soup.role-only", "Roles without controls", "One plain element has a control's role.", "{n} plain elements have a control's role.", "Use the control itself."),
    Message("actions.soup.focusable", "Plain elements that take focus", "One plain element takes focus without a role.", "{n} plain elements take focus without a role.", "Use a control, or drop tabindex."),
    Message("actions.native.ok", "All actions are native", "The one action found is native.", "All {n} actions found are native."),
    Message("webmcp.declarative.present", "Tools declared in forms", "One form is a complete tool.", "{n} forms are complete tools."),
    Message("webmcp.declarative.params", "Tool fields without a description", "One field of a declared tool isn't described.", "{n} fields of declared tools aren't described.", "Describe each field by toolparamdescription."),
    Message("webmcp.declarative.incomplete", "Declared tools are incomplete", "One form declares only part of a tool.", "{n} forms declare only part of a tool.", "Give the form a valid toolname, a tooldescription and names for required fields."),
    Message("webmcp.imperative.referenced", "Tools registered by script", "A script in the page registers a tool."),
    Message("webmcp.imperative.legacy", "Tools registered the old way", "Tools are registered through navigator alone.", None, "Register them through document.modelContext."),
    Message("webmcp.polyfill.present", "Polyfill loaded", "The page loads a polyfill for tools."),
    Message("webmcp.origin-trial.present", "Origin trial", "The page takes part in an origin trial."),
    Message("webmcp.policy.disabled", "A policy switches tools off", "The permissions policy allows tools nowhere.", None, "Take tools=() out of the permissions policy."),
    Message("webmcp.origin-cluster.off", "Origin isn't isolated", "The answer opts out of origin-keyed clusters, which tools need.", None, "Drop the origin-agent-cluster header or set it to ?1."),
    Message("webmcp.none", "No tools for agents", "The page declares and registers no tool.", None, "Declare the page's main form as a tool."),
    Message("webmcp.stub.imperative", "A tool can be made from this page", "A script that registers a tool was made from the page.", None, "Adapt and include the script."),
]
#: Summaries of a check by score: from 75, from 40, below, and where it doesn't apply; {good} is the count of its positive findings.
SUMMARIES = {
    "agent-discovery": ("Agents find what they need ({good} signals).", "Agents find part of what they need ({good} signals).", "Agents find little here ({good} signals).", "Nothing could be observed."),
    "machine-readable-structure": ("The page says what it is.", "The page says in part what it is.", "The page hardly says what it is.", "Doesn't apply."),
    "access-renderability": ("The content comes without a browser.", "Some of the content may need a browser.", "The content is hard to reach without a browser.", "Doesn't apply."),
    "form-semantics": ("Forms can be filled in reliably.", "Forms can be filled in with guesswork.", "Forms can hardly be filled in.", "No form to fill in."),
    "actionability": ("Actions are real controls.", "Some actions are only drawn as controls.", "Actions are hardly usable.", "No action to take."),
    "webmcp-capability": ("The page offers tools.", "The page offers tools in part.", "The page offers hardly any tool.", "Doesn't apply."),
}


def message_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(m) for m in MESSAGES], "id string, title string, detail string, many string, fix string")


def filled_in(text: Column, slots: Column) -> Column:
    """The text with each slot's value in place of its name in braces; values are taken as they are, never read for slots again."""
    parts = F.split(text, r"[{}]", -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.coalesce(slots[x], F.lit(""))).otherwise(x)), "")


def with_texts(findings: DataFrame) -> DataFrame:
    """Findings (id, remediation, slots, ...) with title, detail and advice; advice only where the finding has a remediation.

    An id without a text keeps itself as its title. The table of texts is fixed and broadcast.
    """
    f = findings.join(F.broadcast(message_table(findings.sparkSession)), "id", "left")
    several = F.coalesce(F.col("slots")["n"].try_cast("long") != 1, F.lit(False))
    detail = filled_in(F.when(several, F.coalesce("many", "detail")).otherwise(F.col("detail")), F.col("slots"))
    return f.select(*findings.columns, F.coalesce("title", "id").alias("title"), F.coalesce(detail, F.lit("")).alias("detail_text"), F.when(F.col("remediation"), F.col("fix")).alias("advice"))


def summary_text(category: Column, applicable: Column, score: Column, good: Column) -> Column:
    """The sentence for a check's band of score, null for a check without one."""
    bands = lambda i: F.create_map(*[F.lit(x) for k, v in SUMMARIES.items() for x in (k, v[i])])[category]
    text = F.when(~applicable | score.isNull(), bands(3)).when(score >= 75, bands(0)).when(score >= 40, bands(1)).otherwise(bands(2))
    return F.replace(text, F.lit("{good}"), good.cast("string"))
