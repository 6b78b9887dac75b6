"""Buckets of hashed keys cut into cells of bounded size, so that no hot bucket meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import parallelism, stored

BLOCK = 512
#: Buckets up to which their sizes are broadcast (some 30 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def cells(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, i, j, member) for buckets of two members or more, from distinct (bucket, member).

    A bucket of m members has g = ceil(m / block) blocks, a member lies in one by its hash, and cell (i, j), i <= j,
    holds blocks i and j. Every two members of a bucket share a cell: (i, i) for a block's own pairs, (i, j) for those
    across. A member is written g times, not once for each partner.
    """
    sizes = stored(entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    return placed(entries, sizes, block)


def placed(entries: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    few = sizes.count() <= BROADCAST_ROWS
    g = F.ceil(F.col("m") / F.lit(block)).cast("int")
    held = entries.join(F.broadcast(sizes) if few else sizes, "bucket").select("bucket", "member", g.alias("g"))
    own = F.pmod(F.xxhash64("member", F.lit(3)), F.col("g")).cast("int")
    held = held.select("bucket", "member", own.alias("own"), "g")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    return held.select("bucket", "member", "own", other).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "member", "own")


def pairs_and_cells(entries: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Buckets of two members as pairs (a, b), straight from their counts, and the larger ones as cells.

    Most buckets that hold more than one member hold two, so only few entries are joined again.
    """
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.min("member").alias("a"), F.max("member").alias("b")).where("m > 1")
    sizes = stored(sizes)
    large = sizes.where("m > 2").select("bucket", "m")
    return sizes.where("m = 2 and a <> b").select("a", "b").distinct(), placed(entries, large, block)


def dealt(rows: DataFrame) -> DataFrame:
    """A cell's rows next to each other in one task; a fixed number of tasks, as the work in them is not in their bytes."""
    return rows.repartition(parallelism(rows.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("bucket", "i", "j")) -> Iterator[tuple[tuple, dict]]:
    """Runs of equal keys over sorted batches: (key, columns as lists); a run may cross batches."""
    last, held = None, None
    for b in batches:
        columns = {n: b.column(n).to_pylist() for n in b.schema.names}
        key_rows = list(zip(*(columns[k] for k in keys)))
        start = 0
        for at in range(1, len(key_rows) + 1):
            if at == len(key_rows) or key_rows[at] != key_rows[start]:
                part = {n: c[start:at] for n, c in columns.items()}
                if key_rows[start] == last:
                    for n in held:
                        held[n] += part[n]
                else:
                    if held is not None:
                        yield last, held
                    last, held = key_rows[start], part
                start = at
    if held is not None:
        yield last, held


class Union:
    """Union-find over a cell's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


RESULT = "kind int, a long, b long, n long"  # kind 0: links of a; kind 1: edge a - b


def result(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[1:]], ["kind", "a", "b", "n"])
