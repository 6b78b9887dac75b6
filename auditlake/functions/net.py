"""URLs, addresses and media types as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from auditlake.functions import whatwg
from auditlake.functions.text import SPACE, trim_space

MAX_URL = 2048
#: Hosts and host endings that are never fetched.
BLOCKED_HOSTS = ("localhost", "metadata", "metadata.google.internal", "instance-data", "instance-data.ec2.internal")
BLOCKED_ENDINGS = (".localhost", ".internal", ".local", ".arpa")
URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
#: Type and subtype as RFC 6838 restricts their names: a letter or digit, then letters, digits and some marks.
MEDIA = r"^[a-z0-9][a-z0-9!#$&^_.+-]*/[a-z0-9][a-z0-9!#$&^_.+-]*$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def host(url: Column) -> Column:
    """Lower-case host without user, port; brackets of an IPv6 literal stay."""
    return F.lower(F.regexp_extract(F.regexp_replace(authority(url), "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """Port as text, empty where it is the scheme's own."""
    p = F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    own = F.when(scheme(url) == "http", "80").when(scheme(url) == "https", "443").otherwise("")
    return F.when(p == own, "").otherwise(p)


def origin(url: Column) -> Column:
    p = port(url)
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(p == "", "").otherwise(F.concat(F.lit(":"), p)))


def path_query(url: Column) -> Column:
    path = F.regexp_extract(url, URL, 3)
    return F.concat(F.when(path == "", "/").otherwise(path), F.coalesce(F.regexp_extract(url, URL, 4), F.lit("")))


def classify_ipv4(ip: Column) -> Column:
    """``global`` or ``blocked``; null for what is no dotted quad."""
    a, b = (F.split_part(ip, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2))
    # The ranges that no public host has, by their first two bytes
    blocked = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19, 51)) | ((a == 203) & (b == 0))
    )
    return F.when(ip.rlike(IPV4), F.when(blocked, "blocked").otherwise("global"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times; written out each time it would outgrow a generated method."""
    return F.transform(F.array(value), body)[0]


PARTS = StructType([StructField(n, BooleanType() if n == "user" else StringType()) for n in ("scheme", "user", "host", "port", "path", "query")])
#: URLs that are written as browsers would write them: no port, no address, no dot segments, nothing to escape.
PLAIN = r"^(https?)://((?:[a-z0-9-]+\.)*[a-z][a-z0-9-]*)((?:/(?![.%])[A-Za-z0-9._~!$&'()*+,;=:@%-]*)*)(\?[A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?(?:#.*)?\z"


@F.pandas_udf(PARTS)
def read_urls(raw: pd.Series, base: pd.Series) -> pd.DataFrame:
    """Parts of references, absolute or against a base; all null where there is no URL."""
    out = []
    for r, b in zip(raw, base):
        start = whatwg.parse(b) if b is not None else None
        u = whatwg.parse(r, start) if r is not None and (b is None or start is not None) else None
        out.append((None,) * 6 if u is None else u[:6])
    return pd.DataFrame(out, columns=["scheme", "user", "host", "port", "path", "query"])


def url_of(url: Column, base: Column | None = None) -> Column:
    """A struct of the parts of a URL as browsers read it, its scheme null where there is none (see ``whatwg.Url``).

    What is plain already stays out of Python: only other references, and those that hang on a base, are sent there.
    """
    group = lambda n: F.regexp_extract(url, PLAIN, n)
    plain = url.rlike(PLAIN) & ~F.contains(url, F.lit("xn--"))
    none = F.lit(None).cast("string")
    ready = F.struct(group(1).alias("scheme"), F.lit(False).alias("user"), group(2).alias("host"), F.lit("").alias("port"), F.when(group(3) == "", "/").otherwise(group(3)).alias("path"), group(4).alias("query"))
    return F.when(plain, ready).otherwise(read_urls(F.when(~plain, url), none if base is None else F.when(~plain, base)))


def site_of(u: Column) -> Column:
    return F.concat(u["scheme"], F.lit("://"), u["host"], F.when(u["port"] == "", "").otherwise(F.concat(F.lit(":"), u["port"])))


def written(u: Column) -> Column:
    """A URL's text from its parts, without user and fragment."""
    return F.concat(site_of(u), u["path"], u["query"])


def broken_rule(u: Column) -> Column:
    """The first rule that a URL (``url_of``) breaks, null if none.

    Addresses stand in hosts in their one form: one in brackets is an IPv6 address, one of four numbers an IPv4 address; where it isn't
    global the host is blocked.
    """
    h = u["host"]
    ending = F.lit(False)
    for e in BLOCKED_ENDINGS:
        ending = ending | F.endswith(h, F.lit(e))
    name = ~h.rlike("^[a-z0-9.-]+$") | F.contains(h, F.lit("..")) | ~F.contains(h, F.lit("."))
    v6 = F.startswith(h, F.lit("["))
    blocked = F.when(v6, classify_ipv6(F.when(v6, F.regexp_replace(h, r"[\[\]]", ""))) != "global").when(h.rlike(IPV4), classify_ipv4(h) == "blocked").otherwise(h.isin(*BLOCKED_HOSTS) | ending | name)
    return (
        F.when(u["scheme"].isNull(), "invalid-url")
        .when(~u["scheme"].isin("http", "https"), "scheme")
        .when(u["user"], "userinfo")
        .when(~u["port"].isin("", "80", "443"), "port")
        .when(h == "", "empty-host")
        .when(blocked, "blocked-host")
    )


def reject_reason(url: Column) -> Column:
    """The first rule an absolute URL breaks, null if none."""
    return broken_rule(url_of(trim_space(url)))


def normalise_urls(rows: DataFrame, raw: str = "url") -> DataFrame:
    """``rows`` with ``ok`` and ``value``: the absolute URL without fragment, or why it is none.

    White space around goes, a missing scheme is https. Parts are columns of their own between the steps, so that each is worked out once.
    """
    s = rows.withColumn("_s", trim_space(F.col(raw)))
    full = F.when(F.col("_s").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("_s")).otherwise(F.concat(F.lit("https://"), F.col("_s")))
    s = s.withColumn("_full", full).withColumn("_u", url_of(F.col("_full"))).withColumn("_why", broken_rule(F.col("_u")))
    why = (
        F.when(F.col("_s").isNull() | (F.col("_s") == ""), "empty").when(F.char_length("_s") > MAX_URL, "too-long").when(F.col("_s").rlike(SPACE), "spaces").otherwise(F.col("_why"))
    )
    s = s.withColumn("_why", why)
    return s.select(*rows.columns, F.col("_why").isNull().alias("ok"), F.coalesce("_why", written(F.col("_u"))).alias("value"))


def media_type(header: Column) -> Column:
    """The media type in lower case, null if malformed."""
    mime = F.lower(trim_space(F.split_part(header, F.lit(";"), F.lit(1))))
    return F.when(mime.rlike(MEDIA), mime)


def charset(header: Column) -> Column:
    """The charset parameter in lower case without quotes, null if none or the type is malformed."""
    raw = trim_space(F.regexp_extract(header, r"(?i);\s*charset\s*=([^;]*)", 1))
    return F.when(media_type(header).isNotNull(), F.nullif(F.lower(trim_space(F.regexp_replace(raw, r"^['\"]|['\"]$", ""))), F.lit("")))


#: Labels by which browsers know encodings other than UTF-8, as Python has them.
ENCODINGS = r"^(?:windows-125[0-8]|windows-874|cp125[0-8]|iso-?8859-(?:[1-8]|1[013456])|latin1|l1|ascii|us-ascii|koi8-[ru]|ibm866|macintosh|gbk|gb2312|gb18030|big5|euc-jp|euc-kr|shift[_-]jis|sjis|iso-2022-jp|utf-16(?:le|be)?)$"
#: Labels that mean another encoding than Python's of that name.
RENAMED = {"iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-9": "cp1254", "windows-874": "cp874", "gb2312": "gbk", "macintosh": "mac-roman", "utf-16": "utf-16-le"}


def meta_charset(body: Column) -> Column:
    """The charset that a meta element names within the first 1024 bytes, in lower case; null if none."""
    head = F.decode(F.substring(body, 1, 1024), "ISO-8859-1")
    at = r"(?i)<meta(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])charset\s*=\s*(?:[\"']([^\"']+)[\"']|([^\s/>]+))"
    return F.nullif(F.lower(trim_space(F.coalesce(F.nullif(F.regexp_extract(head, at, 1), F.lit("")), F.regexp_extract(head, at, 2)))), F.lit(""))


@F.pandas_udf(StringType())
def decoded(body: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else bytes(b).decode(RENAMED.get(x, x), "replace") for b, x in zip(body, label)], dtype=object)


def decode_body(body: Column, content_type: Column) -> Column:
    """The text of a binary body: by the header's charset, else the one a meta element names, else UTF-8, as for unknown labels.

    Bytes that the encoding lacks become U+FFFD, a mark of byte order at the start goes; null bodies give null. UTF-8
    stays out of Python.
    """
    label = F.coalesce(charset(content_type), meta_charset(body), F.lit("utf-8"))
    other = label.rlike(ENCODINGS)
    read = F.coalesce(decoded(F.when(other, body), F.when(other, label)), F.make_valid_utf8(F.when(~other, body).cast("string")))
    return F.regexp_replace(read, r"^\x{FEFF}", "")


def content_type_allowed(header: Column, rules: list[str]) -> Column:
    """Exact type, or ``family/*``; without rules everything passes, malformed types never do."""
    if not rules:
        return F.lit(True)
    mime = media_type(header)
    family = F.split_part(mime, F.lit("/"), F.lit(1))
    families = [r[:-2] for r in rules if r.endswith("/*")]
    return F.coalesce(mime.isin(*[r for r in rules if not r.endswith("/*")]) | family.isin(*families), F.lit(False))


def looks_like_html(body: Column) -> Column:
    """An HTML tag within the first 4096 characters, whatever follows its name; or a doctype with any space after marks and prolog."""
    head = F.left(body, F.lit(4096))
    start = r"(?is)^\x{FEFF}?(?:\s++|<!--.*?-->|<\?xml[^>]*\?>)*+<!doctype\s+html(?![A-Za-z0-9_])"
    return head.rlike(start) | head.rlike(r"(?i)<html|<!doctype html|<body|<head|<div|<p[\s>]")


def cut_body(body: Column, most: int) -> Column:
    """(body, n_bytes, truncated): a binary body's first ``most`` bytes, never rejected; null stays null."""
    n = F.octet_length(body)
    return F.when(body.isNotNull(), F.struct(F.substring(body, 1, most).alias("body"), n.cast("long").alias("n_bytes"), (n > most).alias("truncated")))


def hex_int(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def ipv4_normalise(host: Column) -> Column:
    """A host of one to four decimal, octal (0…) or hexadecimal (0x…) numbers as a dotted quad; null for any other.

    All numbers but the last are one byte each, the last fills what is left.
    """
    number = r"(?:0[xX][0-9a-fA-F]*|[0-9]+)"

    def value(x: Column) -> Column:
        hexed, octal = F.lower(x).startswith("0x"), x.rlike("^0[0-7]+$")
        bad = x.rlike("^0[0-9]*[89]") | (F.char_length(x) > 13)
        return F.when(bad, F.lit(None)).when(hexed, F.coalesce(hex_int(F.substring(x, 3, 11)), F.lit(0))).when(octal, F.conv(x, 8, 10).cast("long")).otherwise(x.try_cast("long"))

    def quad(n: Column) -> Column:
        size = F.size(n)
        small = F.forall(F.slice(n, 1, size - 1), lambda v: v < 256)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), size)
        last = F.element_at(n, -1)
        whole = F.aggregate(F.slice(n, 1, size - 1), F.lit(0).cast("long"), lambda acc, v: acc * 256 + v) * room + last
        known = F.forall(n, lambda v: v.isNotNull()) & small & (last < room)
        part = lambda k: F.shiftright(whole, k).bitwiseAND(255).cast("string")
        return F.when(known, F.concat_ws(".", part(24), part(16), part(8), part(0)))

    trimmed = F.regexp_replace(host, r"\.\z", "")
    return F.when(trimmed.rlike(rf"^{number}(?:\.{number}){{0,3}}\z"), bind(F.transform(F.split(trimmed, r"\."), value), quad))


def expand_ipv6(ip: Column) -> Column:
    """The eight groups of an IPv6 address as an array of ints, null if it is none; a zone is cut off, a dotted tail is two groups."""

    def grouped(s: Column) -> Column:
        halves = F.split(s, "::", -1)
        parts = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))
        head, rest = parts(F.element_at(halves, 1)), F.when(F.size(halves) == 2, parts(F.element_at(halves, -1))).otherwise(F.array().cast("array<string>"))

        def filled_up(x: Column) -> Column:
            missing = 8 - F.size(x["head"]) - F.size(x["rest"])
            fits = F.when(x["halves"] == 1, missing == 0).when(x["halves"] == 2, missing >= 0).otherwise(F.lit(False))
            every = F.concat(x["head"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), x["rest"])
            return F.when(fits & F.forall(every, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")), F.transform(every, lambda g: hex_int(g).cast("int")))

        return bind(F.struct(head.alias("head"), rest.alias("rest"), F.size(halves).alias("halves")), filled_up)

    plain = F.regexp_replace(ip, "%.*$", "")
    tail = F.regexp_extract(plain, r"([0-9]+\.[0-9.]+)$", 1)
    byte = lambda i: F.split_part(tail, F.lit("."), F.lit(i)).try_cast("int")
    pair = lambda i: F.lower(F.hex(byte(i) * 256 + byte(i + 1)))
    dotted = F.concat(F.regexp_replace(plain, r"[0-9]+\.[0-9.]+$", ""), pair(1), F.lit(":"), pair(3))
    usable = F.when(tail == "", plain).when(tail.rlike(IPV4), dotted)
    return F.when(F.contains(plain, F.lit(":")), bind(usable, grouped))


def classify_ipv6(ip: Column) -> Column:
    """``global`` or ``blocked``; what is no address is blocked. Addresses that carry an IPv4 one go by that."""

    def judged(g: Column) -> Column:
        at = lambda i: g[i]
        zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        carried = lambda hi, lo: classify_ipv4(F.concat_ws(".", *[x.cast("string") for v in (at(hi), at(lo)) for x in (F.shiftright(v, 8), v.bitwiseAND(255))]))
        return (
            F.when(g.isNull() | (zero(7) & at(7).isin(0, 1)), "blocked")
            .when(zero(5) & (at(5) == 0xFFFF), carried(6, 7))
            .when(zero(6), carried(6, 7))
            .when((at(0) == 0x64) & (at(1) == 0xFF9B) & F.forall(F.slice(g, 3, 4), lambda x: x == 0), carried(6, 7))
            .when(at(0) == 0x2002, carried(1, 2))
            .when((at(0) == 0x2001) & at(1).isin(0, 0x0DB8), "blocked")
            .when(at(0).bitwiseAND(0xE000) == 0x2000, "global")
            .otherwise("blocked")
        )

    return bind(expand_ipv6(ip), judged)


def classify_address(ip: Column) -> Column:
    return F.when(F.contains(ip, F.lit(":")), classify_ipv6(ip)).otherwise(F.coalesce(classify_ipv4(ip), F.lit("blocked")))


def all_global(addresses: Column) -> Column:
    """Whether there is an address and every one is global; null addresses and arrays are not."""
    return F.coalesce((F.size(addresses) > 0) & F.forall(addresses, lambda a: F.coalesce(classify_address(a) == "global", F.lit(False))), F.lit(False))


def capture_headers(headers: Column, dropped: tuple[str, ...] = ("set-cookie", "set-cookie2", "authorization", "proxy-authorization"), most: int = 2048) -> Column:
    """Names in lower case, without the ``dropped`` ones, values cut to ``most`` characters; names that fall together keep the last value."""
    lower = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.left(e["value"], F.lit(most)).alias("value")))
    kept = F.filter(lower, lambda e: ~e["key"].isin(*dropped))
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def url_resolve(href: Column, base: Column) -> Column:
    """A reference against an absolute base, as browsers resolve it, without fragment; null where it is no http(s) URL."""
    u = url_of(href, base)
    return F.when(u["scheme"].isin("http", "https") & ~u["user"], written(u))
