"""The page reader on malformed and hostile markup, and checks on pages that the tables lack."""

from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.functions import relations
from auditlake.functions.html import elements, read
from auditlake.operators import checks
from auditlake.operators.elements import controls, shred
from auditlake.plans.pages import plain


def tags(html):
    """Tags and parents below the body, whose html, head and body every page has."""
    found = elements(html)
    first = next((e.pre for e in found if e.tag == "body"), -1) + 1
    return [(e.tag, e.parent - first if e.parent is not None and e.parent >= first else None) for e in found[first:]]


def test_what_ends_what():
    assert tags("<p>a<p>b<div>c</div></p>") == [("p", None), ("p", None), ("div", None), ("p", None)]
    assert tags("<ul><li>1<ul><li>2</ul><li>3</ul>") == [("ul", None), ("li", 0), ("ul", 1), ("li", 2), ("li", 0)]
    assert tags("<table><tr><td>1<td>2<tr><td>3</table>") == [("table", None), ("tbody", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 5)]
    assert tags("<form><form><input></form>") == [("form", None), ("input", 0)]


def test_text_attributes_and_raw_content():
    _, _, title, script, _, a = elements("<TITLE>a <b>\n&amp; c</TITLE><script>if (a<b) '</p>'</script><a HREF='x>y' href=z Id>t</a>")
    assert title.text == "a <b> & c" and script.text == "if (a<b) '</p>'"
    assert a.attrs == {"href": "x>y", "id": ""} and a.text == "t"


def test_unclosed_parts_run_to_the_end():
    assert tags("<b>x<!-- <i>") == [("b", None)] and tags('<b>x<a href="y>z') == [("b", None)] and tags("") == [] and tags(None) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<a href='", "<!--", ">", "\"", "x", "<script>", "</", "<form", "&#0;", "<td>", "="]), max_size=30).map("".join))
def test_any_markup_gives_a_tree(html):
    found = elements(html)
    assert [e.pre for e in found] == list(range(len(found)))
    for e in found:
        assert e.pre <= e.last < len(found)
        if e.parent is not None:
            assert found[e.parent].pre < e.pre and e.last <= found[e.parent].last and found[e.parent].depth == e.depth - 1


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def test_checks_on_null_empty_and_bare_pages(spark):
    pages = frame(spark, None, "", "text", "<div></div>")
    nodes = shred(pages)
    for check, score in ((checks.check_structure, 0), (checks.check_forms, None), (checks.check_actions, None)):
        assert {r.page_id: r.score for r in check(pages, nodes).collect()} == dict.fromkeys(range(4), score)


def test_names_and_owners_of_controls(spark):
    page = (
        '<form id="a"><input id="i" aria-labelledby="x  nope y"><button type="button">b</button></form><b id="x">One</b><b id="y">Two</b>'
        '<input form="a" title=" T "><input form="gone"><label for="k"></label><label>Around<select id="k"></select></label>'
        '<form><input name="q"><input type="image"></form><input type="hidden">'
    )
    got = sorted(controls(shred(frame(spark, page))).collect(), key=lambda r: r.pre)
    # A label that names the control decides even where it is empty
    assert [(r.tag, r.name, r.owned_by is not None, r.submits) for r in got] == [
        ("input", "One Two", True, False), ("input", "T", True, False), ("input", None, False, False), ("select", None, False, False), ("input", None, True, True),
    ]


def test_kinds_of_soup(spark):
    page = '<a></a><a name="n">x</a><a href=" # ">x</a><a href="JavaScript:void(0)">x</a><div tabindex=0>x</div><li role="TAB">x</li><div role="button" onclick="f()"><img alt="Go"></div>'
    pages = frame(spark, page, "<a href='/x'>Buy</a><button></button>")
    empty, bought = sorted(plain(checks.check_actions(pages, shred(pages))).collect(), key=lambda r: r.page_id)
    assert (empty.score, empty.ids) == (0, "actions.soup.dead-links,actions.soup.focusable,actions.soup.handlers,actions.soup.role-only")
    assert (bought.score, bought.ids) == (85, "actions.button.unnamed,actions.native.ok,actions.primary.native")


def test_contexts_are_inherited_through_graphs_only():
    assert relations.block_types('{"@context":{"x":["http://SCHEMA.org"]},"@type":" A ","child":{"@type":"B"},"@graph":[[{"@type":"C"}]]}') == (True, True, ["A", "C"])
    assert relations.block_types('{"@type":"A"}') == (True, False, []) and relations.block_types("NaN") == (False, False, []) and relations.block_types("[") == (False, False, [])


def test_parts_left_out_part_the_words_around_them():
    assert read("<p>a b</p><script src=x></script><footer>&copy; c")[1] == "a b © c"
    assert read("<p>a<style>s</style><noscript><p>n</p></noscript>b<i>c</i><svg><title>t</title></svg></p>")[1] == "a bc"
