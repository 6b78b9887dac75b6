"""Helpers shared by the corpus operators: tokenisation, durable cuts, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes outside the word class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` become spaces, A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text (A-Z lower-cased) as UTF-8 bytes; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a fresh local one only where none is set and all is one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(spark, "_auditlake_scratch", None) or "file://" + tempfile.mkdtemp(prefix="auditlake-")
        spark._auditlake_scratch = where
    return where.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table: smaller than a checkpoint, and read by column in few tasks."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Edges that one task may join up by union-find (16 bytes each); more are contracted first.
TAIL_EDGES = 100_000


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, rep) of every end of the edges: union-find over at most TAIL_EDGES of them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    ends = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([root(x) for x in ends], pa.int64())], ["a", "rep"])


def connected_components(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: rows (node, component), component the smallest node reached.

    ``nodes``: one column ``node`` of long, distinct, or None for the ends of all edges but loops; ``edges``: columns
    ``a``, ``b`` of long, any direction and repetition. Randomised contraction: in each round every vertex hooks to the member of its closed neighbourhood
    with the smallest seeded hash, and edges are relabelled; loops and repeats go. Edges shrink by a constant factor a
    round, and no step needs a vertex's neighbours together in one task. Once TAIL_EDGES or fewer are left, one task
    joins them up. The rounds' maps are then composed backwards.
    """
    live = stored(edges.where("a <> b").select("a", "b").distinct())
    maps: list[DataFrame] = []
    while (n := live.count()) > TAIL_EDGES:
        seed = F.lit(7919 * (len(maps) + 1))
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("v"))
        hooks = stored(hooks.select("a", F.least("m", own)["v"].alias("rep")))
        maps.append(hooks)
        left, right = hooks.select("a", F.col("rep").alias("ra")), hooks.select(F.col("a").alias("b"), F.col("rep").alias("rb"))
        joined = live.join(left, "a").join(right, "b").where("ra <> rb")
        live = stored(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if n:
        maps.append(live.repartition(1).mapInArrow(joined_up, "a long, rep long"))
    if not maps:
        return placed_in(nodes, live.select(F.col("a").alias("node"), F.col("b").alias("component")))  # no rows to place
    label = maps[-1]
    if len(maps) == 1 and n:  # union-find alone: representatives are smallest nodes already
        return placed_in(nodes, stored(label).select(F.col("a").alias("node"), F.col("rep").alias("component")), few=True)
    for earlier in maps[-2::-1]:
        later = label.select(F.col("a").alias("rep"), F.col("rep").alias("rep2"))
        label = earlier.join(later, "rep", "left").select("a", F.coalesce("rep2", "rep").alias("rep"))
    label = stored(label)
    least = label.groupBy("rep").agg(F.min("a").alias("component"))
    return placed_in(nodes, label.join(least, "rep").select(F.col("a").alias("node"), "component"))


def placed_in(nodes: DataFrame | None, named: DataFrame, few: bool = False) -> DataFrame:
    """``named`` for every node, a node without a component being its own; ``few``: of at most two ends an edge of TAIL_EDGES."""
    if nodes is None:
        return named
    return nodes.join(F.broadcast(named) if few else named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
