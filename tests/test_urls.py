"""URLs as browsers read them, address classes of hosts, and redirect chains over recorded answers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import net, whatwg

BASE = whatwg.parse("https://h.example/a/b?q")
ABSOLUTE = {
    "http://bücher.example/": "http://xn--bcher-kva.example/", "http://ex%61mple.com/": "http://example.com/", "http:example.com/x": "http://example.com/x", "http://a.example:0080/": "http://a.example/",
    "HTTP://EXAMPLE.com:443/%7Ea/../b?x y#f": "http://example.com:443/b?x%20y", "https://a.example:443": "https://a.example/", "http:\\\\a.example\\p\\..\\q": "http://a.example/q", "  http://a.example/\t \n": "http://a.example/",
    "http://0x7f.1/": "http://127.0.0.1/", "http://2130706433": "http://127.0.0.1/", "http://1.2.3": "http://1.2.0.3/", "http://[::FFFF:1.2.3.4]/": "http://[::ffff:102:304]/", "http://[1:0:0:2:0:0:0:3]": "http://[1:0:0:2::3]/",
    "http://a.example/a/./b/%2e%2E/c/.": "http://a.example/a/c/", "http://a.example/..": "http://a.example/", "http://a.example/{é}^": "http://a.example/%7B%C3%A9%7D%5E", "http://a.example?'\"": "http://a.example/?%27%22",
    "http://faß.example/": "http://xn--fa-hia.example/", "http://Ａ.example/": "http://a.example/", "http://a。example/": "http://a.example/", "http:////a.example/": "http://a.example/", "ftp://a.example:21/x": "ftp://a.example/x",
    "mailto:a b": "mailto:a%20b".replace("%20", " "), "http://u:p@a.example/": "http://a.example/", "http://a.example/%zz%": "http://a.example/%zz%",
}
INVALID = ["", "a.example", "http://", "http:///", "http://a b/", "http://a.example:x/", "http://a.example:65536/", "http://[::1", "http://[1::2::3]/", "http://256.1.1.1/", "http://1.2.3.4.5/", "http://a%00b/", "http://a<b/", "http://@/", "http://09.1/", "//a.example", "http://[::1%25eth0]/", "http://xn--/", "1http://a.example"]
SEEN = {
    "": "https://h.example/a/b?q", "#f": "https://h.example/a/b?q", "?z": "https://h.example/a/b?z", "c": "https://h.example/a/c", "../c": "https://h.example/c", "/c/": "https://h.example/c/", "//o.example": "https://o.example/",
    "\\c": "https://h.example/c", "/\\o.example/x": "https://o.example/x", "https:c": "https://h.example/a/c", "https:/c": "https://h.example/c", "http:c": "http://c/", "%2e%2e/d": "https://h.example/d", "a b": "https://h.example/a/a%20b", "./": "https://h.example/a/", "..": "https://h.example/",
}


def test_absolute_urls():
    for raw, want in ABSOLUTE.items():
        u = whatwg.parse(raw)
        assert u is not None and whatwg.written(u) == want, raw
    assert [raw for raw in INVALID if whatwg.parse(raw) is not None] == []
    assert whatwg.parse("http://u@a.example/").user and not whatwg.parse("http://@a.example/").user


def test_references_against_a_base():
    for raw, want in SEEN.items():
        assert whatwg.written(whatwg.parse(raw, BASE)) == want, raw


@settings(max_examples=300, deadline=None)
@given(st.text("htp:/\\.@[]?#%2eé \ta0x1", max_size=24))
def test_written_urls_are_read_as_themselves(raw):
    for u in (whatwg.parse("http:" + raw), whatwg.parse(raw, BASE)):
        if u is not None and not u.opaque:
            again = whatwg.parse(whatwg.written(u))
            assert again is not None and again == u._replace(user=False), raw


def test_plain_urls_are_read_alike_in_both_ways(spark):
    raw = ["http://a.example", "https://a-b.c.example/x/y.z?q=1&r=%20#f", "https://a.example/.x", "https://a.example/%2e/x", "http://a.example//x", "http://localhost/", "https://xn--bcher-kva.example/", "http://a.1/", "http://a.example/aé", *ABSOLUTE, *INVALID]
    got = spark.createDataFrame([(r,) for r in raw], "u string").select("u", net.url_of(F.col("u")).alias("p")).collect()
    for r in got:
        u = whatwg.parse(r.u)
        assert tuple(r.p) == ((None,) * 6 if u is None else u[:6]), r.u


def test_reasons(spark):
    why = {
        "http://a.example/": None, "http://bücher.example/": None, "http:a.example": None, "http://a.example:0080/": None, "http://a.example:8080/": "port", "ftp://a.example/": "scheme", "http://u@a.example": "userinfo", "x": "invalid-url",
        "http://127.0.0.1/": "blocked-host", "http://0x7f000001/": "blocked-host", "http://8.8.8.8/": None, "http://[::1]/": "blocked-host", "http://[2606:4700::1]/": None, "http://[::ffff:10.0.0.1]/": "blocked-host", "http://localhost/": "blocked-host",
        "http://a.internal/": "blocked-host", "http://a..b/": "blocked-host", "http://a_b.example/": "blocked-host", "http://256.1.1.1/": "invalid-url", "javascript:alert(1)": "scheme", "http://LOCALHOST%2elocaldomain/": None,
    }
    got = spark.createDataFrame([(k,) for k in why], "u string").select("u", net.reject_reason(F.col("u")).alias("r")).collect()
    assert {r.u: r.r for r in got} == why
    n = net.normalise_urls(spark.createDataFrame([("Bücher.example/a b",), ("  Bücher.example/é ",), ("http://a.example/%2e%2e/x#y",), ("",), ("x" * 3000,)], "u string"), "u").select("ok", "value").collect()
    assert [tuple(r) for r in n] == [(False, "spaces"), (True, "https://xn--bcher-kva.example/%C3%A9"), (True, "http://a.example/x"), (False, "empty"), (False, "too-long")]


def test_redirect_chains(spark):
    from auditlake.operators.redirects import follow_redirects

    chain = [(f"https://h.example/{i}", 301, f"/{i - 1}") for i in range(1, 6)] + [("https://h.example/0", 200, None)]
    hub = [(f"https://h.example/s{i}", 302, "0") for i in range(3000)]
    odd = [
        ("https://h.example/loop", 307, "loop"), ("https://h.example/none", 301, None), ("https://h.example/blank", 301, ""), ("https://h.example/down", 301, "http://h.example/0"), ("https://h.example/bad", 301, "http://[1/"),
        ("https://h.example/inner", 308, "https://127.0.0.1/"), ("https://h.example/away", 303, "//o.example/"), ("https://o.example/", 404, None), ("https://h.example/lost", 301, "/unknown"), ("https://h.example/304", 304, "/0"), (None, 200, None),
    ]
    answers = spark.createDataFrame(chain + hub + odd, "url string, status int, location string")
    asked = [u for u, *_ in chain + odd] + ["HTTPS://H.example:443/1#f", "ftp://h.example/", "https://h.example/new"]
    requests = spark.createDataFrame([(i, u, "x") for i, u in enumerate(asked)] + [(1000 + i, u, "x") for i, (u, *_) in enumerate(hub)], "id int, url string, status string")
    rows = follow_redirects(requests, answers).collect()
    got = {asked[r.id]: (r.hops, r.code) for r in rows if r.id < 1000}
    h = "https://h.example/"
    assert [got[f"{h}{i}"] for i in range(6)] == [(0, "ok"), (1, "ok"), (2, "ok"), (3, "ok"), (3, "too-many-redirects"), (3, "too-many-redirects")]
    want = {"loop": (3, "too-many-redirects"), "none": (0, "redirect-invalid"), "blank": (0, "redirect-invalid"), "down": (0, "redirect-downgrade"), "bad": (0, "redirect-invalid"), "inner": (0, "redirect-invalid"), "away": (1, "ok"), "lost": (1, "network"), "304": (0, "ok"), "new": (0, "network")}
    assert {k: got[h + k] for k in want} == want and got["HTTPS://H.example:443/1#f"] == (1, "ok") and got["ftp://h.example/"] == got[None] == (0, "invalid-url")
    assert all((r.hops, r.code, r.final_url) == (1, "ok", h + "0") for r in rows if r.id >= 1000) and len(rows) == len(asked) + 3000
    locked = {asked[r.id]: r.code for r in follow_redirects(requests.where("id < 1000"), answers, same_origin=True).collect()}
    assert locked[h + "away"] == "redirect-invalid" and locked[h + "2"] == "ok"
    assert follow_redirects(requests.limit(0), answers).count() == 0
