"""Checks on worked pages, address classes, the streaming limiter, null keys."""

from auditlake.functions import net
from auditlake.functions.html import elements, read
from auditlake.operators import access, audit, discovery, limiter, tools
from auditlake.operators.elements import shred
from auditlake.plans.pages import plain
from auditlake.sources.cuts import cut
from auditlake.streaming.limiter import rate_limit_stream
from pyspark.sql import functions as F

READY = """<!doctype html><html lang="en"><head><title>T</title><meta name="description" content="d"><meta property="og:title" content="t"><meta property="og:description" content="t"><link rel="canonical" href="/">
<link rel="service-desc" href="/openapi.json"><link type="application/rss+xml" href="/f"><script type="application/ld+json">{"@context":"https://schema.org","@type":"Place"}</script></head><body><header></header><nav></nav><main>
<h1>Book</h1><h2>Table</h2><form toolname="book" tooldescription="Books"><label>Name <input name="name" required toolparamdescription="n" autocomplete="name"></label><label>Email <input name="email" type="email" autocomplete="email"></label>
<button>Book now</button></form><a href="/x">More</a>%s</main><footer></footer></body></html>""" % ("word " * 60)
SOUP = '<html><head><script src="/a.js"></script><script src="/b.js"></script></head><body><noscript>You need to enable JavaScript</noscript><div id="root"></div><div onclick="x()"></div><script>window.c={}</script></body></html>'


def pages(spark, *html, headers=None, status=200):
    rows = [(i, "https://n.example/", h, status, headers or {}) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status int, headers map<string,string>")


def sidecars(spark, got, others):
    """The fixed targets of page 0: ``got`` by path, the rest seen as 404 or not seen."""
    rows = []
    for i, (key, path) in enumerate(discovery.TARGETS):
        seen, body = (True, got[path]) if path in got else (others == "404", None)
        rows.append((0, key, path, i, seen, 200 if body is not None else 404 if seen else None, body))
    return spark.createDataFrame(rows, "page_id long, key string, path string, ord int, observed boolean, status int, body string")


def test_access_of_ready_and_script_pages(spark):
    p = pages(spark, READY, SOUP)
    ready, soup = sorted(plain(access.check_access(p, shred(p))).collect(), key=lambda r: r.page_id)
    assert (ready.score, ready.confidence) == (100, "high") and "access.js.static" in ready.ids
    assert (soup.score, soup.confidence) == (35, "low") and "access.js.required" in soup.ids


def test_access_headers_by_whole_words(spark):
    p = pages(spark, READY, headers={"x-robots-tag": "noaindex", "x-px-cookie": "1"}, status=500)
    r = plain(access.check_access(p, shred(p))).first()
    assert (r.score, r.confidence) == (80, "medium") and "noai" not in r.ids and "bot-management" in r.ids


def test_tools(spark):
    p = pages(spark, READY, SOUP, '<script>navigator.modelContext.registerTool({})</script>')
    got = {r.page_id: r for r in plain(tools.check_webmcp(p, shred(p))).collect()}
    # Half of the controls are described
    assert got[0].score == 70 and got[1].score == 0 and (got[2].score, got[2].confidence) == (25, "medium") and "legacy" in got[2].ids
    off = pages(spark, READY, headers={"permissions-policy": "a=(), tools = ( )"})
    assert plain(tools.check_webmcp(off, shred(off))).first().score == 0
    alone = pages(spark, READY, headers={"origin-agent-cluster": "?0"})
    assert plain(tools.check_webmcp(alone, shred(alone))).first().score == 20


def test_discovery_absent_is_not_unobserved(spark):
    p = pages(spark, READY)
    nodes = shred(p)
    full = {"/robots.txt": "User-agent: *\nAllow: /", "/sitemap.xml": "<urlset>", "/llms.txt": "# N", "/.well-known/mcp.json": '{"name":"n"}'}
    score = lambda s, n=nodes, q=p: plain(discovery.check_discovery(q, n, s)).first()
    seen, unseen = score(sidecars(spark, full, "404")), score(sidecars(spark, {}, "none"))
    assert (seen.score, seen.confidence, unseen.score, unseen.confidence) == (100, "high", 100, "low")
    markup = {"/robots.txt": "<html>", "/llms.txt": "<!doctype html>", "/.well-known/mcp.json": "[1]"}
    r = score(sidecars(spark, markup, "404"))
    assert "robots.missing" in r.ids and "llms.missing" in r.ids and "mcp.invalid" in r.ids


def test_audit_of_ready_null_and_empty_pages(spark):
    bare = F.when(F.col("page_id") > 0, F.lit(None))
    p = pages(spark, READY, None, "").withColumn("headers", bare.otherwise(F.col("headers"))).withColumn("status", bare.otherwise(F.col("status")))
    results = cut(audit.run_checks(p, sidecars(spark, {"/robots.txt": "User-agent: *\nAllow: /"}, "404")))
    got = {r.page_id: r for r in audit.audit_rows(results).collect()}
    assert len(got) == 3 and all(r.overall is not None for r in got.values())
    assert got[0].coverage == 1.0 and got[0].superpower == 70 and got[0].survival > 80 and got[0].grade in "AB"


def test_paths_end_at_ids_and_count_siblings():
    found = {e.tag + (e.attrs.get("n", "")): e.path for e in elements('<body><div><p>a</p><p n="2">b</p></div><section id="s"><ul><li n="x">c</li></ul></section></body>')}
    assert found["p2"] == "div > p:nth-of-type(2)" and found["lix"] == "section#s > ul > li" and found["body"] == ""
    deep = elements("<div>" * 9)[-1].path
    assert deep.count(">") == 5
    assert read("<head><title>t</title></head><body>a <script>b</script><svg><title>c</title></svg> d")[1] == "a d"


def test_addresses(spark):
    ips = {
        "8.8.8.8": "global", "127.0.0.1": "blocked", "::1": "blocked", "::": "blocked", "::ffff:10.0.0.1": "blocked", "::ffff:8.8.8.8": "global", "64:ff9b::7f00:1": "blocked", "2002:0808:0808::": "global",
        "2001::1": "blocked", "fd00:ec2::254": "blocked", "ff02::1": "blocked", "2001:db8::1": "blocked", "100::1": "blocked", "2606:4700:4700::1111": "global", "1:2:3": "blocked", "::1::": "blocked", "::ffff:300.1.1.1": "blocked",
        "g::1": "blocked", "fe80::1%eth0": "blocked", "": "blocked",
    }
    got = spark.createDataFrame([(k,) for k in ips], "ip string").select("ip", net.classify_address(F.col("ip")).alias("c")).collect()
    assert {r.ip: r.c for r in got} == ips
    hosts = {"2130706433": "127.0.0.1", "0x7f.1": "127.0.0.1", "0177.0.0.1": "127.0.0.1", "127.1": "127.0.0.1", "0xffffffff": "255.255.255.255", "4294967296": None, "1.2.3.4.5": None, "256.1.1.1": None, "a.b": None, "09.1.1.1": None, "0": "0.0.0.0", "1.2.3.4.": "1.2.3.4"}
    got = spark.createDataFrame([(k,) for k in hosts], "h string").select("h", net.ipv4_normalise(F.col("h")).alias("q")).collect()
    assert {r.h: r.q for r in got} == hosts


def test_null_keys_share_one_window(spark):
    rows = [(None, i, f"2024-01-01 00:00:{i:02d}") for i in range(10)] + [((1 << 53) + 1, 100, "2024-01-01 00:00:00")]
    e = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = limiter.rate_limit(e, most=2).collect()
    assert sum(r.ok for r in got if r.user_id is None) == 2 and [r.user_id for r in got if r.event_id == 100] == [(1 << 53) + 1]


def test_streaming_limiter_equals_the_batch_form(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    first = e.orderBy("ts").limit(500)
    first.write.parquet(f"file://{tmp_path}/in/a")
    later = e.join(first, "event_id", "left_anti")
    for _ in "ab":  # the second run goes on from the first one's state
        stream = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/in/*")
        q = rate_limit_stream(stream, window_ms=86_400_000, most=2).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        if _ == "a":
            later.write.parquet(f"file://{tmp_path}/in/b")
    out = spark.read.parquet(f"file://{tmp_path}/out").collect()
    want = {r.event_id: (r.ok, r.retry_after_s) for r in limiter.rate_limit(e, window_ms=86_400_000, most=2).collect()}
    assert {r.event_id: (r.ok, r.retry_after_s) for r in out} == want


def test_list_state_limiter_equals_the_batch_form(spark, tmp_path):
    """Null keys, a hot key, late batches and a restart; then state that expires by the clock."""
    import time

    from auditlake.streaming.limiter import STATE_STORE, rate_limit_state

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, STATE_STORE)
    try:
        rows = [(None if i % 5 == 0 else 7 if i % 2 else i % 11, i, 1_700_000_000 + i * 7) for i in range(600)]
        e = spark.createDataFrame(rows, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
        e.where("event_id < 203").repartition(3).write.parquet(f"file://{tmp_path}/in/a")

        def run(out, **more):
            stream = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/in/*")
            w = rate_limit_state(stream, most=3, **more).writeStream.format("parquet").option("path", f"file://{tmp_path}/{out}").option("checkpointLocation", f"file://{tmp_path}/{out}-cp")
            if not more:
                assert w.trigger(availableNow=True).start().awaitTermination(120)
                return
            q = w.start()  # a query whose state expires runs on
            try:
                until = time.time() + 60
                while time.time() < until and not any(p["numInputRows"] for p in q.recentProgress):
                    time.sleep(1)
            finally:
                q.stop()

        run("all")
        run("brief", ttl_ms=1000)
        time.sleep(2)
        e.where("event_id >= 203").write.parquet(f"file://{tmp_path}/in/b")
        run("all")  # goes on from what the first run left
        run("brief", ttl_ms=1000)
        want = {r.event_id: (r.user_id, r.ok, r.retry_after_s) for r in limiter.rate_limit(e, most=3).collect()}
        got = {r.event_id: (r.user_id, r.ok, r.retry_after_s) for r in spark.read.parquet(f"file://{tmp_path}/all").collect()}
        assert got == want and {k for k, _, _ in got.values()} >= {None, 7} and not all(ok for _, ok, _ in got.values())
        # What the first run kept is gone: the second part is judged as if it came alone
        fresh = {r.event_id: r.ok for r in limiter.rate_limit(e.where("event_id >= 203"), most=3).collect()}
        brief = {r.event_id: r.ok for r in spark.read.parquet(f"file://{tmp_path}/brief").where("event_id >= 203").collect()}
        assert brief == fresh and brief != {k: v[1] for k, v in want.items() if k >= 203}
    finally:
        spark.conf.set(provider, before)


def test_carried_addresses_and_cut_references(spark):
    ips = spark.createDataFrame([("2002:70ee::1",), ("2002:7f00:1::1",)], "ip string")
    assert [r[0] for r in ips.select(net.classify_ipv6(F.col("ip"))).collect()] == ["global", "blocked"]
    assert next(e for e in elements("<h1>and&amp;&amp</h1>") if e.tag == "h1").text == "and&&"
