"""Trees of pages, worked by hand from the rules of HTML, and the cost of hostile ones."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.functions.html import read, tree

TREES = {
    "<p>a<p>b": "p(a) p(b)", "<b>1<p>2</b>3</p>": "b(1) p(b(2) 3)", "<p>1<b>2<i>3</b>4</i>5</p>": "p(1 b(2 i(3)) i(4) 5)", "<b><p>x</p></b>": "b(p(x))", "<a>1<a>2": "a(1) a(2)", "<a><div>1</a>2</div>": "a() div(a(1) 2)",
    "<b><em><foo><foob><fooc><aside></b></em>": "b(em(foo(foob(fooc())))) aside(b())", "<b><em><foo><foob><aside></b></em>": "b(em(foo(foob()))) em() aside(em(b()))", "<p><b><p>x": "p(b()) p(b(x))", "<div><b>a</div>c": "div(b(a)) b(c)",
    "<table><tr><td>1<td>2<tr><td>3</table>x": "table(tbody(tr(td(1) td(2)) tr(td(3)))) x", "<table>a<b>c<tr><td>d</table>e": "a b(c) table(tbody(tr(td(d)))) b(e)", "<table><div>d</div><tr><th>h": "div(d) table(tbody(tr(th(h))))",
    "<table><input type=hidden><input><tr>": "input() table(input() tbody(tr()))", "<table><form><tr><td><input></form></table>": "table(form() tbody(tr(td(input()))))", "<table><col><tr><th>h": "table(colgroup(col()) tbody(tr(th(h))))",
    "<table><caption>c<tr><td>x": "table(caption(c) tbody(tr(td(x))))", "<table><tr><td><table><tr><td>i</table>o": "table(tbody(tr(td(table(tbody(tr(td(i)))) o))))", "<p><table></table>": "p(table())", "<!doctype html><p><table></table>": "p() table()",
    "<ul><li>1<ul><li>2</ul><li>3</ul>": "ul(li(1 ul(li(2))) li(3))", "<dl><dt>a<dd>b<dt>c": "dl(dt(a) dd(b) dt(c))", "<h1>a<h2>b": "h1(a) h2(b)", "<button>1<button>2": "button(1) button(2)", "x</p>": "x p()", "x</br>y": "x br() y",
    "<select><option>1<option>2<optgroup><option>3</select>y": "select(option(1) option(2) optgroup(option(3))) y", "<select>1<input>": "select(1) input()", "<form><form><input></form>x": "form(input()) x", "<div></form><form>x": "div(form(x))",
    "<svg><circle/><title>q</title></svg>z": "svg(circle() title(q)) z", "<svg><p>x": "svg() p(x)", "<math><mi><b>x</b></mi></math>": "math(mi(b(x)))", "<image>x": "img() x", "<textarea>\n<b>&amp;</textarea>": "textarea(<b>&)", "<body><p>a</body></html>t": "p(a t)",
    "<tr><td>x": "x", "<div><template><tr><td>x</td></tr></template>y</div>": "div(template(tr(td(x))) y)", "<nobr>1<nobr>2": "nobr(1) nobr(2)", "<ruby>a<rt>b<rt>c": "ruby(a rt(b) rt(c))", "<object><b>x</object>y": "object(b(x)) y",
}


def shown(node):
    return node if isinstance(node, str) else f"{node.tag}({' '.join(map(shown, node.children))})"


@pytest.mark.parametrize("html", list(TREES))
def test_bodies(html):
    page = tree(html).children[0]
    assert [x.tag for x in page.children] == ["head", "body"] and " ".join(map(shown, page.children[1].children)) == TREES[html]


def test_heads_and_framesets():
    whole = {
        "<title>t</title><p>x": "html(head(title(t)) body(p(x)))", "<head></head><link><p>": "html(head(link()) body(p()))", "<frameset><frame><frame></frameset>": "html(head() frameset(frame() frame()))", "x": "html(head() body(x))",
        "<html lang=a><head><meta></head> <body class=b>y<body id=i><html dir=d>": "html(head(meta())   body(y))", "<noscript><p>n</noscript>z": "html(head(noscript(<p>n)) body(z))", "<script>a<b></script><template><p>q</template>": "html(head(script(a<b>) template(p(q))) body())",
    }
    for html, want in whole.items():
        assert shown(tree(html).children[0]) == want
    root = tree("<html lang=a><body class=b><body id=i class=c><html dir=d>").children[0]
    assert root.attrs == {"lang": "a", "dir": "d"} and root.children[1].attrs == {"class": "b", "id": "i"}


@pytest.mark.parametrize("html", ["<div>" * 60_000, "<p><b>" * 12_000, "<b><div>" * 3000 + "</b>" * 3000, "<table><tr><td>" * 12_000, "<table>" + "a<b>" * 15_000, "<a><p></a>" * 12_000, "<ul><li>" * 15_000, "".join(f"<font size={i}>" for i in range(4000)) + "<p>x" * 150])
def test_hostile_pages_take_no_longer_than_their_length_allows(html):
    began = time.thread_time()
    found, _ = read(html)
    assert found and time.thread_time() - began < 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <b> </b> <a> </a> <i> <div> </div> <table> </table> <tr> <td> </td> x <li> <ul> </ul> <select> <option> </select> <form> </form> <svg> </svg> <template> </template> <caption> <button> <h1> </h2> <frameset> <body> </body> <head> <script> </script> <nobr> <object> </object> <dd> <col> <input>".split()), max_size=40).map("".join))
def test_any_order_of_tags_gives_a_tree(html):
    found, _ = read(html)
    assert [e.pre for e in found] == list(range(len(found))) and all(e.parent is None or found[e.parent].last >= e.last for e in found)
    assert sum(e.tag == "html" for e in found) == (1 if html else 0) and sum(e.tag == "body" for e in found) <= 1
