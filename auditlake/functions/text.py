"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space class of ECMAScript, which Java's ``\s`` lacks in part.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def beginning(c: Column, most: int) -> Column:
    """As much of a text as its first ``most`` characters after collapsing need, and two more."""
    no = SPACE[:1] + "^" + SPACE[1:]
    return F.regexp_extract(c, rf"^(?:{SPACE}*+{no}){{0,{most + 2}}}", 0)


def excerpt(c: Column, most: int = 300) -> Column:
    """Collapsed text; beyond ``most`` characters it is cut and ends in an ellipsis."""
    t = collapse(beginning(c, most))
    return F.when(F.char_length(t) > most, F.concat(F.left(t, F.lit(most - 1)), F.lit("…"))).otherwise(t)


def escape_attr(c: Column, most: int | None = 60) -> Column:
    """Collapsed text, cut before it is escaped for an attribute; None cuts nothing."""
    out = collapse(c) if most is None else F.left(collapse(beginning(c, most)), F.lit(most))
    for raw, safe in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def slug(c: Column, most: int = 40) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+", "")
    return F.regexp_replace(F.left(s, F.lit(most)), r"_+\z", "")


def json_string(c: Column) -> Column:
    """A JSON string literal that is safe inside a script: ``< > &`` and the line separators are escaped as well."""
    escapes = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    escapes += [(x, f"\\u{ord(x):04x}") for x in "<>&\u2028\u2029"]
    escapes += [(chr(i), f"\\u{i:04x}") for i in range(32) if chr(i) not in "\n\r\t\b\f"]
    for raw, safe in escapes:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), c, F.lit('"'))


def schema_type(tag: Column, kind: Column) -> Column:
    """JSON type of a form control."""
    k = F.lower(F.coalesce(kind, F.lit("text")))
    return F.when(tag != "input", "string").when(k.isin("number", "range"), "number").when(k == "checkbox", "boolean").otherwise("string")


def product_token(c: Column) -> Column:
    """A crawler's product token: lower case, up to white space or a slash."""
    return F.regexp_extract(F.lower(trim_space(c)), r"^[^\s/]*", 0)


def allowed_fields(sent: Column, names: tuple[str, ...], most: int) -> Column:
    """Of a map of strings the entries of these names, their values cut to ``most`` characters; null values are empty."""
    kept = F.map_filter(sent, lambda k, _: k.isin(*names))
    return F.transform_values(kept, lambda _, v: F.left(F.coalesce(v, F.lit("")), F.lit(most)))


# The fields of a reservation, and what a body and a value may hold.
RESERVATION_FIELDS = ("name", "email", "phone", "date", "time", "party_size", "notes")
MOST_BODY_BYTES, MOST_VALUE_CHARS = 8192, 200


def form_entries(body: Column) -> Column:
    """An urlencoded body as an array of (key, value), decoded; what can't be decoded stays as it is."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    pairs = F.filter(F.split(body, "&", -1), lambda x: x != "")
    return F.transform(pairs, lambda x: F.struct(decoded(F.regexp_extract(x, r"^([^=]*)", 1)).alias("key"), decoded(F.regexp_extract(x, r"(?s)^[^=]*=?(.*)\z", 1)).alias("value")))


def last_of_each(entries: Column) -> Column:
    """A map of (key, value) entries; a repeated key keeps its last value."""
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])))


def reservation(body: Column, content_type: Column, names: tuple[str, ...] = RESERVATION_FIELDS, most_bytes: int = MOST_BODY_BYTES, most: int = MOST_VALUE_CHARS) -> Column:
    """(status, fields) of a posted body: 413 over ``most_bytes``, 400 where it is neither a JSON object nor urlencoded, else 200 with the
    fields of these names, cut. A null body is empty, a null type none; values that are no strings are their JSON text, null is empty."""
    text, kind = F.coalesce(body, F.lit("")), F.coalesce(content_type, F.lit(""))
    parsed = F.map_entries(F.from_json(text, "map<string,string>"))
    sent = F.when(kind.contains("application/json"), parsed).when(kind.contains("application/x-www-form-urlencoded"), form_entries(text))
    sent = F.filter(sent, lambda e: e["key"].isin(*names))
    small = F.octet_length(text) <= most_bytes
    fields = F.when(small, allowed_fields(last_of_each(sent), names, most))
    return F.struct(F.when(~small, 413).when(sent.isNull(), 400).otherwise(200).alias("status"), fields.alias("fields"))


def client_key(forwarded: Column) -> Column:
    """The first address of a forwarding header, else ``anon``."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), F.lit("anon"))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")
