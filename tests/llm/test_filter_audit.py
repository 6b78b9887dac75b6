"""The filter audit against plain Python over documents one by one."""

import re
from itertools import permutations

import pytest

from auditlake.llm import filter_audit
from auditlake.llm.queries import QUERIES

DOCS = "doc_id long, text string, source string, mask int, good string, n int"
LABELS = "doc_id long, quality int, toxic int, text string"


def failed(rows):
    """The letters each (doc_id, text) fails, by the contract's words."""
    out = []
    for i, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u in rows)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": re.search("[#$%&*|]", t), "E": smaller}
        out.append({x for x in fails if fails[x]})
    return out


def brute(rows, labels):
    good, toxic = ({i for i, q, t, *_ in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails, want = failed([r[:2] for r in rows]), {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                past = set(order[: step - 1])
                removed = [i for i, f in own if x in f and not f & past]
                kept = sum(not f & (past | {x}) for _, f in own)
                redundant = sum(bool(x in f and f & past) for _, f in own)
                alone = sum(f == {x} for _, f in own)
                want[part, order, step] = [kept, len(removed), redundant, alone, sum(i in good for i in removed), sum(i in toxic for i in removed)]
                total[x] += len(removed)
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                want[part, order, step].append(total[x])
    return {k: tuple(v) for k, v in want.items()}


def got(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [
        prose, prose, prose, None, "", "   ", "one two", "one two", "ÀÉ A\x1cB c", "a\tb\nc\x0bd\x0ce\rf", "CAPS " * 60, "same same " * 40,
        prose + " #", prose + "\n" + "x " * 9000, " " + prose, "$", "$", "A" * 300,
    ]
    rows = [(i * 3 % 23, t, ["s", None, "", "t"][i % 4], 1, "g", 2) for i, t in enumerate(texts)]
    rows += [rows[0], rows[1], (None, prose, "s", 1, "g", 2), (None, "only", "u", 1, "g", 2), (None, "only", "u", 1, "g", 2), (rows[0][0], prose, "t", 1, "g", 2), (rows[2][0], "else", "s", 1, "g", 2)]
    rows += [(100 + i, prose, f"h{i % 3}", 1, "g", 2) for i in range(30)]
    labels = [(i, i % 2, int(i % 5 == 0), "x") for i in range(0, 120, 1)] + [(3, 0, 1, "x"), (3, 1, 0, "x"), (None, 1, 1, "x"), (6, None, None, "x")]
    return rows, labels, spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_against_documents_one_by_one(tables):
    rows, labels, docs, said = tables
    cells = filter_audit.failure_cells(docs, said)
    assert sum(r.n for r in cells.collect()) == len(rows)
    assert got(filter_audit.order_metrics(cells, "ABCDE")) == brute(rows, labels)


def test_other_filters(spark, tables):
    _, _, docs, said = tables
    from pyspark.sql import functions as F

    short = {"X": F.length("text") < 20, "Y": F.lit(None).cast("boolean")}
    cells = filter_audit.failure_cells(docs, said, short, repeat=None)
    out = filter_audit.order_metrics(cells, "XY").where("filter_order = 'YX'").groupBy("step").agg(F.sum("removed").alias("removed")).collect()
    assert {r.step: r.removed for r in out} == {1: 0, 2: docs.where("coalesce(length(text), 0) < 20").count()}
    with pytest.raises(ValueError):
        filter_audit.order_metrics(cells, "ABCDEFG")


def test_empty(tables):
    _, _, docs, said = tables
    assert filter_audit.order_metrics(filter_audit.failure_cells(docs.limit(0), said), "ABCDE").count() == 0
    cells = filter_audit.failure_cells(docs, said.limit(0)).collect()
    assert sum(r.good + r.toxic for r in cells) == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(QUERIES["op11_filter_audit"](spark, sf)) == brute(docs, labels)
