"""License rules: versions by short names, offers of two licenses, and the keywords against a scan of every rule."""

import pyarrow.parquet as pq
import pytest

from auditlake.llm import licenses
from auditlake.llm.common import words_of


def labels(text):
    return {s[2] for s in licenses.scan(text)[2]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released as GNU GPL version 3, see below", "gpl-3"),
        ("GPLv3 code", "gpl-3"),
        ("under GPL v2 or later", "gpl-2"),
        ("LGPL-2.1-or-later", "lgpl-2.1"),
        ("AGPL3 applies", "agpl-3"),
        ("the MPL version 2.0 holds", "mpl-2"),
        ("EUPL v1.2", "eupl-1.2"),
        ("dual licensed under the MIT license and the Apache license", "dual"),
        ("dual licensed under GPLv2 or a commercial license", "dual"),
        ("dual-licensed under either MIT or BSD", "dual"),
    ],
)
def test_versions_and_offers(text, want):
    assert want in labels(f"First words. {text} and last words")


@pytest.mark.parametrize("text", ["dual licensed under the sun and moon", "a dual licensed under secretary and clerk", "Python version 3 and PHP v7", "the gplus version 3", "mpl only", "gpl 3 apples"])
def test_no_license_in_like_words(text):
    assert labels(f"First words. {text} and last words") == set()


def every_rule(text):
    """Spans by all rules one after the other, without keywords, and by suppression of each with each."""
    line = (b" " + b" ".join(words_of(text)) + b" ").decode("utf-8", "replace")
    found = [(m.start(), m.end(), licenses.PRIORITY[r.kind], i) for i, r in enumerate(licenses.rules()) for m in r.pattern.finditer(line)]
    found.sort(key=lambda d: (-d[2], d[0] - d[1], d[3], d[0]))
    kept = []
    for d in found:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return [(line[:a].count(" ") - 1, line[a:b].count(" ") + 1, licenses.rules()[i].label, licenses.rules()[i].kind) for a, b, _, i in sorted(kept)]


def without_words(rule):
    """Rules that the naive scan opens but keywords need not: by design they ask for a word for license anywhere in the text."""
    return any("licen" in ks for ks in rule.keywords) and "licen" not in rule.pattern.pattern.replace("(?: licen[sc]e)?", "")


def test_keywords_pass_over_nothing(monkeypatch):
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist() if t]
    texts += [f"{a}. {b} license, {c}" for a in ("GNU GPL version 3", "under the MIT license", "apache 2", "dual licensed under MIT or BSD") for b in ("mpl 2.0", "cc by nc 4.0", "zlib") for c in ("LGPL v2.1 only", "SPDX-License-Identifier: EPL-2.0", "")]
    hits = 0
    for t in texts:
        got, licensed = licenses.scan(t)[2], "licen" in t.lower()
        if licensed or not any(without_words(r) and r.pattern.search(f" {t.lower()} ") for r in licenses.rules()):
            assert got == every_rule(t), t
            hits += bool(got)
    assert hits >= 30
