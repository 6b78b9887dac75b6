"""The audit from SQL: the page reader as a table function, and views over elements, results, findings and scores."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.html import read
from auditlake.operators import audit, scoring
from auditlake.operators.elements import shred
from auditlake.sources.cuts import cut

ELEMENT = "page_id bigint, pre int, last int, depth int, parent int, tag string, attrs map<string,string>, text string, form int, label int, path string"


class PageElements:
    """``page_elements(TABLE(SELECT page_id, html FROM ...))``: a row an element of each page, whatever other columns the table has."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        names = ["page_id", "pre", "last", "depth", "parent", "tag", "attrs", "text", "form", "label", "path"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for page, html in zip(pages.column("page_id").to_pylist(), pages.column("html").to_pylist()):
            rows = [(page, e.pre, e.last, e.depth, e.parent, e.tag, list(e.attrs.items()), e.text, e.form, e.label, e.path) for e in read(html)[0]]
            if rows:
                yield pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def register_functions(spark: SparkSession) -> None:
    """Make ``page_elements`` known to the session's SQL."""
    spark.udtf.register("page_elements", F.arrow_udtf(PageElements, returnType=ELEMENT))


def register_views(spark: SparkSession, pages: DataFrame, sidecars: DataFrame) -> None:
    """Temporary views ``nodes``, ``results``, ``findings`` and ``scores`` of an audit; the outcomes are cut, so that SQL over them doesn't repeat it."""
    register_functions(spark)
    results = cut(audit.run_checks(pages, sidecars))
    shred(pages, kept=False).createOrReplaceTempView("nodes")
    results.createOrReplaceTempView("results")
    audit.findings_of(results).createOrReplaceTempView("findings")
    scoring.summarize(results).createOrReplaceTempView("scores")
