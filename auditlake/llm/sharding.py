"""Operator 3: sharding by a two-pass external shuffle.

Pass one deals records to memory-sized buckets by a seeded hash; pass two runs a Fisher-Yates shuffle over each
bucket and writes it. Buckets end to end are one uniform random order, which is cut into shards whose row counts
differ by one at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auditlake.llm.common import parallelism, read_table, shared_dir

SHARDS = 24
SEED = 20240229
BUCKET_BYTES = 48 << 20


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of n, the same for the same seed (numpy's permutation is a Fisher-Yates shuffle)."""
    return np.random.default_rng(seed).permutation(n)


def write_shards(docs: DataFrame, where: str, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> None:
    """Write all rows as Parquet under ``where/shard=N``: the row as struct ``record``, and its ``slot`` in the shard.

    The bucket hash covers key and text, so a hot source or many copies of a text under different keys spread
    evenly; rows equal in both share a bucket. Null keys and texts are hashed as nulls and kept. Rows of a bucket are
    put in (key, text) order before the shuffle, so a repeated task gives the same order. Empty input writes nothing
    but the folder.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    n = max(parallelism(spark), -(-total // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64(F.lit(seed), docs[key], docs[text]), F.lit(n)).cast("int")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), bucket.alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))  # one row a bucket
    counts = counts.withColumn("before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n"))
    before = {r["bucket"]: r["before"] for r in counts.collect()}
    all_rows = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        number = table.column("bucket")[0].as_py()
        order = fisher_yates(table.num_rows, (seed, number))
        # Shard k holds positions from ceil(k * all / shards) on
        position = before[number] + np.arange(table.num_rows, dtype=np.int64)
        shard = position * shards // all_rows
        slot = position - (shard * all_rows + shards - 1) // shards
        out = table.select(["record"]).take(pa.array(order))
        out = out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))
        yield from out.to_batches(max_chunksize=2000)

    schema = T.StructType([rows.schema["record"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    dealt = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions(f"record.`{key}`", f"record.`{text}`")
    dealt.mapInArrow(run, schema).write.partitionBy("shard").parquet(where)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``documents`` into 24 shards of near equal row counts, and each row's shard and slot as read back (see ``write_shards`` for nulls and repeats)."""
    docs, where = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, where)
    layout = T.StructType([T.StructField("record", docs.schema), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    text = F.coalesce("record.text", F.lit(""))
    return spark.read.schema(layout).parquet(where).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
